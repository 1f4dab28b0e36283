"""Generated pairs: why they are rejected, and the threshold read off real ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .kernels import token_distance_udf


def divergence(pairs: DataFrame) -> DataFrame:
    """Pairs with the share of tokens that differ: distance over the longer length."""
    a, b = tokens(F.col("correct")), tokens(F.col("learner"))
    share = F.coalesce(F.try_divide(token_distance_udf(a, b), F.greatest(F.size(a), F.size(b))), F.lit(0.0))
    return pairs.withColumn("divergence", share)


def repeats(words: Column, limit: int = 3) -> Column:
    """Whether a token stands more than ``limit`` times in a row."""
    def found(w: Column) -> Column:
        last = F.size(w) - limit
        same = lambda i: F.forall(F.sequence(F.lit(1), F.lit(limit)), lambda k: F.get(w, i + k) == F.get(w, i))
        return F.when(last < 1, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(0), last - 1), same))

    # held in an array of one, the words are found once, not at each place
    return F.transform(F.array(words), found)[0]


def rejection(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs with ``reason``, null for the fit ones; the first that applies."""
    rows = divergence(pairs.withColumns({"correct": F.trim("correct"), "learner": F.trim("learner")}))
    words = tokens(F.col("learner"))
    ratio = F.size(words) / F.greatest(F.size(tokens(F.col("correct"))), F.lit(1))
    reason = (
        F.when(F.col("learner") == "", "empty")
        .when(repeats(words), "degenerate repetition")
        .when((F.col("asked") == 0) & (F.col("learner") == F.col("correct")), F.lit(None))
        .when(F.col("asked") == 0, "asked for none, damaged anyway")
        .when(F.col("learner") == F.col("correct"), "copied when asked for errors")
        .when(~ratio.between(0.5, 1.6), "length ratio out of range")
        .when(F.col("divergence") > threshold, "more damaged than real learner German")
    )
    return rows.withColumn("reason", reason)


def discrete_quantile(rows: DataFrame, column: str, q: float) -> DataFrame:
    """The value at place min(n - 1, floor(q * n)) of the sorted values. Values are counted
    first, so the window runs over distinct ones."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(1))
    upto = F.sum("n").over(one.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select(column, upto.alias("upto"), F.sum("n").over(one).alias("total"))
    place = F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total")))
    return placed.where(F.col("upto") > place).agg(F.min(column).alias("threshold"))
