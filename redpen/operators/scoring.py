"""Scores of system edits against gold edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import f_score, precision, recall


def span_join(gold: DataFrame, system: DataFrame, mode: str = "correction") -> DataFrame:
    """Gold and system edits (sid, start, end, correction, error_type, ordinal) joined
    outright by key. ``detection`` leaves the correction out. Of equal keys on a side the
    first ordinal's type counts. Rows: sid, key columns, gold_type, system_type."""
    if mode not in ("correction", "detection"):
        raise ValueError(f"no such mode: {mode}")
    key = ["sid", "start", "end", *(["correction"] if mode == "correction" else [])]
    side = lambda d, name: d.groupBy(*key).agg(F.min_by("error_type", "ordinal").alias(name))
    return side(gold, "gold_type").join(side(system, "system_type"), key, "full_outer")


def counts_by_type(joined: DataFrame) -> DataFrame:
    """tp, fp, fn by type; a hit is filed under the gold type, a false one under the system's."""
    hit = F.col("gold_type").isNotNull() & F.col("system_type").isNotNull()
    return joined.groupBy(F.coalesce("gold_type", "system_type").alias("error_type")).agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("gold_type").isNull()).alias("fp"), F.count_if(F.col("system_type").isNull()).alias("fn")
    )


def with_scores(counts: DataFrame, beta: float = 0.5) -> DataFrame:
    c = F.col
    return counts.withColumns({"precision": precision(c("tp"), c("fp")), "recall": recall(c("tp"), c("fn")), "f": f_score(c("tp"), c("fp"), c("fn"), beta)})


def mark_moves(edits: DataFrame) -> DataFrame:
    """Edits (sid, ordinal, error_type, words) where a deletion and an insertion of the same
    word and category in a sentence are one move: both get ``moved``. Of several with the
    same key the last counts."""
    category = F.get(F.split("error_type", ":"), F.lit(1))
    keyed = edits.withColumn("category", category).withColumn("op", F.substring("error_type", 1, 1))
    of = lambda op: F.max(F.when(F.col("op") == op, F.col("ordinal")))
    pairs = keyed.where("op in ('U', 'M') and category is not null and words is not null").groupBy("sid", "category", "words").agg(of("U").alias("u"), of("M").alias("m")).where("u is not null and m is not null")
    moved = pairs.select("sid", F.explode(F.array("u", "m")).alias("ordinal")).withColumn("moved", F.lit(True))
    return edits.join(moved, ["sid", "ordinal"], "left").withColumn("moved", F.coalesce("moved", F.lit(False)))


def overlap(a: Column, b: Column, start: Column, end: Column) -> Column:
    """Whether an edit overlaps the window [a, b); a zero-width edit counts its borders."""
    return F.when(start == end, (a <= start) & (start <= b)).otherwise((a < end) & (start < b))
