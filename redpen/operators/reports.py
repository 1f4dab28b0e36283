"""Tables of results: rankings, marginal rates, pivots, notes, and files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one() -> Window:
    return Window.partitionBy(F.lit(1))


def ranked_types(counts: DataFrame, least: int = 1) -> DataFrame:
    """Types (error_type, tp, fp, fn) with at least so many gold edits, most first."""
    gold = F.col("tp") + F.col("fn")
    return counts.where(gold >= least).withColumn("gold", gold).orderBy(F.desc("gold"), "error_type")


def injection_weights(types: DataFrame, rates: DataFrame, recalls: DataFrame, blind: float = 0.10, boost: float = 2.0) -> DataFrame:
    """The share of each injectable type: its natural rate, more where a system's recall is
    at most ``blind``, made to sum to 1. A type without a rate has 0; one without a recall
    isn't boosted."""
    rows = types.select("error_type").distinct().join(rates, "error_type", "left").join(recalls.select("error_type", "recall"), "error_type", "left")
    lifted = F.coalesce("rate", F.lit(0.0)) * F.when(F.col("recall") <= blind, boost).otherwise(1.0)
    return rows.withColumn("lifted", lifted).select("error_type", F.coalesce(F.try_divide("lifted", F.sum("lifted").over(_one())), F.lit(0.0)).alias("weight"))


def break_even(tp: Column, fn: Column, proposed: Column) -> Column:
    """The hit rate that one more edit needs to raise F0.5."""
    return F.coalesce(F.try_divide(tp, proposed + 0.25 * (tp + fn)), F.lit(0.0))


def against_controls(results: DataFrame, controls: list[tuple[str, str]], default: str, least_margin: int = 20) -> DataFrame:
    """Results (name, tp, fn, proposed, f) beside their control: that of the first prefix
    of their name in ``controls``, else the default. Rows: name, f, control, delta, added,
    hit_rate (null for fewer than ``least_margin`` more or less edits), needed."""
    control = F.lit(default)
    for prefix, name in reversed(controls):
        control = F.when(F.startswith("name", F.lit(prefix)), name).otherwise(control)
    other = results.select(F.col("name").alias("control"), *[F.col(c).alias(f"c_{c}") for c in ("tp", "fn", "proposed", "f")])
    rows = results.withColumn("control", control).join(other, "control", "left")
    own = F.col("name") == F.col("control")
    added = F.when(~own, F.col("proposed") - F.col("c_proposed"))
    return rows.select(
        "name", "f", "control", F.when(~own, F.col("f") - F.col("c_f")).alias("delta"), added.alias("added"),
        F.when(F.abs(added) >= least_margin, F.try_divide(F.col("tp") - F.col("c_tp"), added)).alias("hit_rate"),
        F.when(~own, break_even(F.col("c_tp"), F.col("c_fn"), F.col("c_proposed"))).alias("needed"),
    )


def type_table(recalls: DataFrame, systems: list[str], top: int = 15) -> DataFrame:
    """Recall by type (rows, the most frequent ``top``) and system (columns); ``recalls`` has
    error_type, system, gold, recall."""
    gold = recalls.groupBy("error_type").agg(F.max("gold").alias("gold")).orderBy(F.desc("gold"), "error_type").limit(top)
    return recalls.join(gold.select("error_type"), "error_type", "left_semi").groupBy("error_type").pivot("system", systems).agg(F.first("recall"))


def top_rules(fired: DataFrame, top: int = 100) -> DataFrame:
    """The rules that fire most (rule, n, the share of all that these and those before cover)."""
    ranked = fired.groupBy("rule").agg(F.count("*").alias("n"))
    total = F.sum("n").over(_one())
    upto = F.sum("n").over(_one().orderBy(F.desc("n"), "rule").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("covered", F.try_divide(upto, total)).orderBy(F.desc("n"), "rule").limit(top)


def worst_type(confusions: DataFrame, least: int = 50, top: int = 3) -> DataFrame:
    """Of types with ``least`` gold edits the one of lowest agreement, with what it is
    most often taken for. ``confusions`` has gold_type, system_type, n."""
    by = confusions.groupBy("gold_type").agg(F.sum("n").alias("gold"), F.coalesce(F.sum(F.when(F.col("gold_type") == F.col("system_type"), F.col("n"))), F.lit(0)).alias("same"))
    worst = by.where(F.col("gold") >= least).withColumn("agreement", F.col("same") / F.col("gold")).orderBy("agreement", "gold_type").limit(1)
    others = confusions.where("gold_type <> system_type").join(worst, "gold_type")
    return others.orderBy(F.desc("n"), "system_type").limit(top).select("gold_type", "agreement", "system_type", "n")


def ranking(models: DataFrame, value: str = "fertility") -> DataFrame:
    """Models from the lowest value on, with their rank (equal ones share it)."""
    return models.withColumn("rank", F.rank().over(_one().orderBy(value))).orderBy("rank", "name")


def headline(projections: DataFrame, threshold: float = 0.999) -> DataFrame:
    """The projection of each model whose threshold is nearest."""
    best = projections.groupBy("name").agg(F.min_by(F.struct(*[c for c in projections.columns if c != "name"]), F.abs(F.col("threshold") - threshold)).alias("p"))
    return best.select("name", "p.*")


def size_budget(params: Column, removed: Column, bits: float) -> Column:
    """Bytes of what is left of a model's parameters at so many bits each."""
    return ((params - removed) * bits / 8).cast("bigint")


def generation_faults(answers: DataFrame) -> DataFrame:
    """Totals of parsed answers (``answer`` of training.parse_answer, ``source``): total,
    invalid (no correction), recovered (an incomplete one), unchanged."""
    text = F.col("answer.correction")
    return answers.agg(
        F.count("*").alias("total"), F.count_if(text.isNull()).alias("invalid"),
        F.count_if(text.isNotNull() & ~F.col("answer.complete")).alias("recovered"), F.count_if(text == F.col("source")).alias("unchanged"),
    )


def uncited(rows: DataFrame, cited: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows (``ref``) that no text cites and no note excuses, with the reason."""
    out = rows.join(cited.select("ref").distinct().withColumn("cited", F.lit(True)), "ref", "left").join(notes.select("ref", "note"), "ref", "left")
    return out.where(F.col("cited").isNull() & F.col("note").isNull()).select("ref", F.lit("neither cited nor excused").alias("reason"))


def rules_without_template(rules: DataFrame, templates: DataFrame) -> DataFrame:
    return rules.select("rule").distinct().join(templates.select("rule"), "rule", "left_anti").orderBy("rule")


def stored_split(split: Column, name: Column) -> Column:
    """The split of a stored result; of one without it, by its name's end."""
    return F.coalesce(split, F.when(F.endswith(name, F.lit("-test")), "test").otherwise("dev"))


def weight_shares(encoded: DataFrame) -> DataFrame:
    """Of the supervised tokens of encoded rows (``labels``, ``weights``): how many have each
    weight, and their share."""
    each = encoded.select(F.explode(F.arrays_zip("labels", "weights")).alias("t")).where("t.labels <> -100").groupBy(F.col("t.weights").alias("weight")).agg(F.count("*").alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(_one()))


def markdown(table: DataFrame, order: list[str], most: int = 1000) -> str:
    """A small table as Markdown; raises above ``most`` rows, as it is read by the driver."""
    rows = table.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "-|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def write_csv(table: DataFrame, path: str) -> None:
    """A folder of CSV files with a header; empty strings stay apart from nulls."""
    table.write.mode("overwrite").option("header", True).option("emptyValue", '""').option("nullValue", "").option("escape", '"').csv(path)


def write_json_lines(table: DataFrame, path: str) -> None:
    """A folder of JSON-lines files; null fields stay."""
    table.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lines(table: DataFrame, column: str, path: str) -> None:
    """A folder of text files, a line a row; a row with a line feed raises, as it would be two."""
    line = F.when(F.contains(column, F.lit("\n")), F.raise_error(F.lit("a line has a line feed")).cast("string")).otherwise(F.col(column))
    table.select(line.alias("value")).write.mode("overwrite").text(path)
