"""The stateless prose filter over a stream, with keys deduplicated within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_clean, normalise, tokens


def clean_stream(lines: DataFrame, language: str = "de", delay: str = "10 minutes", least: int = 8, most: int = 60) -> DataFrame:
    """Clean sentences of a stream with columns ``ts`` and ``sentence``; a key that was seen
    within the delay doesn't come again. The first copy counts only if it is clean, since a
    stream can't know what its state has forgotten."""
    size = F.size(tokens(F.col("sentence")))
    kept = lines.where(is_clean(F.col("sentence"), language) & size.between(least, most)).withColumn("key", normalise(F.col("sentence")))
    return kept.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])
