"""Seeded samples, screens, shots and prefixes. The order of a draw is the SHA-256 of a seed
and a key: the same on every run, and a longer draw extends a shorter one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import churn_udf


def draw_key(seed: str, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def bucket(edits: Column) -> Column:
    """The stratum of a sentence by its number of edits: 0, 1, 2, 3 to 4, 5 or more."""
    return F.when(edits <= 2, edits).when(edits <= 4, 3).otherwise(4)


def first(rows: DataFrame, seed: str, key: str, size: int) -> DataFrame:
    """The first ``size`` rows of the seeded order: every task sorts its own and keeps no
    more, so the last sort has ``size`` rows a task."""
    return rows.withColumn("_h", draw_key(seed, key)).orderBy("_h", key).limit(size).drop("_h")


def at_least(rows: DataFrame, seed: str, key: str, size: int) -> DataFrame:
    """As ``first``; raises if there are fewer rows."""
    out = first(rows, seed, key, size)
    got = out.count()
    if got < size:
        raise RuntimeError(f"{got} rows are left of {size}: the filters are too strict")
    return out


def part(rows: DataFrame, seed: str, key: str, offset: int, size: int) -> DataFrame:
    """Rows ``offset`` up to ``offset + size`` of the seeded order."""
    return first(rows, seed, key, offset + size).join(first(rows, seed, key, offset).select(key), key, "left_anti")


def complement(rows: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """The rows that aren't in the sample."""
    return rows.join(sample.select(key), key, "left_anti")


def budgets(rows: DataFrame, seed: str, key: str, weights: dict[int, float]) -> DataFrame:
    """``rows`` with a number ``budget`` for each, drawn by the weights: the share that the
    hash of its key is of all falls between two sums of them."""
    share = F.conv(F.substring(draw_key(seed, key), 1, 13), 16, 10).cast("double") / float(16**13)
    total, upto, out = sum(weights.values()), 0.0, None
    for value, weight in sorted(weights.items())[:-1]:
        upto += weight / total
        out = F.when(share < upto, value) if out is None else out.when(share < upto, value)
    last = F.lit(max(weights))
    return rows.withColumn("budget", last if out is None else out.otherwise(last))


def shots(rows: DataFrame, count: int, seed: str, key: str = "sid", correct_share: float = 0.22, most_churn: float = 0.5) -> DataFrame:
    """Worked examples (key, source, target, edits > 0) for a prompt, in a seeded order.

    Rows have ``tokens``, ``target_tokens``, ``n_edits``. A share is correct already; of the
    others those go that replace more than ``most_churn`` of the sentence, after the draw,
    and the next ones in order fill their places; where none is left they come back. At
    most 16 times ``count`` rows are looked at for it."""
    wrong = count - round(count * correct_share)
    fine = first(rows.where("n_edits = 0"), f"{seed}:correct", key, count - wrong).withColumn("rejected", F.lit(False))
    drawn = first(rows.where("n_edits > 0"), f"{seed}:wrong", key, 16 * max(wrong, 1))
    judged = drawn.withColumn("rejected", churn_udf("tokens", "target_tokens") > most_churn).withColumn("_h", draw_key(f"{seed}:wrong", key))
    kept = judged.orderBy("rejected", "_h", key).limit(wrong).drop("_h")
    joined = fine.unionByName(kept).withColumn("_h", draw_key(f"{seed}:order", key)).orderBy("_h", key)
    return joined.select(key, F.array_join("tokens", " ").alias("source"), F.array_join("target_tokens", " ").alias("target"), "n_edits")


def screen(rows: DataFrame, size: int, seed: str, key: str, stratum: Column) -> DataFrame:
    """A sample of ``size`` rows in the proportions of the strata, each share rounded half to
    even; rows of a null stratum are one of their own.

    A row's hash is compared with the share that its stratum gives before any rows are
    ranked: what a binomial draw may at most exceed it by is kept, and only that is ranked.
    Where the cut leaves too few, all rows of the stratum are ranked."""
    named = rows.withColumn("_s", F.coalesce(stratum.cast("string"), F.lit("\u0000null")))
    counts = named.groupBy("_s").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    quota = counts.select("_s", "_n", F.bround(F.col("_n") * size / total).cast("int").alias("_q"))
    cut = F.least(F.lit(1.0), (F.col("_q") + 8 * F.sqrt(F.greatest(F.col("_q"), F.lit(1))) + 32) / F.col("_n"))
    table = F.broadcast(quota) if _few(quota) else quota
    placed = named.withColumn("_h", draw_key(seed, key)).join(table, "_s")
    below = placed.where(F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") / float(16**13) <= cut)
    enough = below.groupBy("_s").agg(F.count("*").alias("_got"))
    short = quota.join(enough, "_s", "left").where(F.coalesce("_got", F.lit(0)) < F.col("_q")).select("_s")
    pool = below.join(short, "_s", "left_anti").unionByName(placed.join(short, "_s", "left_semi"))
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_h", key)))
    return ranked.where("_r <= _q").drop("_s", "_h", "_r", "_n", "_q")


def _few(table: DataFrame, most: int = 100_000) -> bool:
    """Whether a table has few enough rows to be broadcast."""
    return table.limit(most + 1).count() <= most
