"""A rule checker's matches: reading, caching, and which injected error each belongs to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "matches array<struct<message:string,offset:int,length:int,replacements:array<struct<value:string>>,rule:struct<id:string,issueType:string,category:struct<id:string>>>>"
MATCH = "struct<rule_id:string,message:string,offset:int,length:int,replacements:array<string>,category:string,issue_type:string>"


def from_response(payload: Column) -> Column:
    """The matches of a checker's JSON response as an array of MATCH; null of what isn't JSON."""
    found = F.from_json(payload, PAYLOAD)["matches"]
    return F.transform(
        found,
        lambda m: F.struct(
            m["rule"]["id"].alias("rule_id"), m["message"].alias("message"), m["offset"].alias("offset"), m["length"].alias("length"),
            F.coalesce(F.transform(m["replacements"], lambda r: r["value"]), F.array().cast("array<string>")).alias("replacements"),
            m["rule"]["category"]["id"].alias("category"), m["rule"]["issueType"].alias("issue_type"),
        ),
    )


def excerpt(text: Column, match: Column) -> Column:
    """The characters of a text that a match is about."""
    return F.substring(text, match["offset"] + 1, match["length"])


def best_replacement(match: Column) -> Column:
    """The first replacement; null if there is none."""
    return F.get(match["replacements"], F.lit(0))


def cache_key(text: Column, version: str, language: str, params: str = "{}") -> Column:
    """A key of all that a response depends on."""
    return F.sha2(F.to_json(F.array(F.lit(version), F.lit(language), F.lit(params), text)), 256)


def checked(texts: DataFrame, cache: DataFrame, fetch: Callable[[list[str]], list[str]], version: str, language: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``texts`` with ``matches`` (the JSON response), and the rows (key, text, matches) that
    the cache lacked. Every distinct text it lacks is fetched once, a batch at a time."""
    keyed = texts.withColumn("key", cache_key(F.col(text_col), version, language))
    asked = keyed.select("key", F.col(text_col).alias("text")).distinct().join(cache.select("key"), "key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(matches=fetch(part["text"].tolist()))

    fresh = asked.mapInPandas(run, "key string, text string, matches string")
    known = cache.select("key", "matches").unionByName(fresh.select("key", "matches"))
    return keyed.join(known, "key", "left").drop("key"), fresh


def windows(edits: DataFrame, spans: Column, tolerance: int = 1) -> DataFrame:
    """Edits (start, end over tokens; ``spans``, the tokens' character offsets) with the
    characters from ``low`` to ``high`` of their tokens and ``tolerance`` more on both
    sides; null for an edit behind the sentence."""
    first = F.greatest(F.col("start") - tolerance, F.lit(0))
    last = F.least(F.col("end") + tolerance, F.size(spans))
    behind = first >= F.size(spans)
    end = F.when(last > 0, F.get(spans, last - 1)["end"]).otherwise(F.get(spans, first)["end"])
    return edits.withColumn("low", F.when(~behind, F.get(spans, first)["start"])).withColumn("high", F.when(~behind, end))


#: Characters of a block in which matches and windows meet.
_BLOCK = 256


def _blocks(begin: Column, end: Column) -> Column:
    """The blocks of characters that [begin, end) reaches into; null where it is empty."""
    block = lambda at: F.floor(at / _BLOCK)
    return F.when(begin < end, F.sequence(block(begin), block(end - 1)))


def attributed(matches: DataFrame, windowed: DataFrame) -> DataFrame:
    """Each match (sid, match, offset, length, rule_id) with the edit (``ordinal``,
    error_type) of its sentence whose window it shares most characters with, the first of
    equal ones; matches that share none with any go. They meet by blocks of characters, so
    a long sentence's matches aren't compared with all of its edits; a pair that meets in
    two blocks is one pair twice and counts the same."""
    edits = windowed.select("sid", "ordinal", "error_type", "low", "high", F.explode(_blocks(F.col("low"), F.col("high"))).alias("block"))
    asked = matches.select("sid", "match", "offset", "length", "rule_id", F.explode(_blocks(F.col("offset"), F.col("offset") + F.col("length"))).alias("block"))
    joined = asked.join(edits, ["sid", "block"])
    shared = F.least(F.col("offset") + F.col("length"), F.col("high")) - F.greatest("offset", "low")
    best = joined.withColumn("shared", shared).where("shared > 0").groupBy("sid", "match").agg(F.min_by(F.struct("ordinal", "error_type", "rule_id"), F.struct(-F.col("shared"), F.col("ordinal"))).alias("b"))
    return best.select("sid", "match", "b.*")


def detection(windowed: DataFrame, hits: DataFrame) -> DataFrame:
    """By error type: injected errors, those that a match is about, and the rule that is
    most often (the first by name of equal ones)."""
    # both uses of the hits read the same columns, so that they are found once
    hits = hits.groupBy("sid", "ordinal", "error_type", "rule_id").agg(F.count("*").alias("n"))
    found = hits.select("sid", "ordinal").distinct().withColumn("hit", F.lit(1))
    counts = windowed.join(found, ["sid", "ordinal"], "left").groupBy("error_type").agg(F.count("*").alias("injected"), F.count("hit").alias("detected"))
    rules = hits.groupBy("error_type", "rule_id").agg(F.sum("n").alias("n"))
    top = rules.groupBy("error_type").agg(F.min_by("rule_id", F.struct(-F.col("n"), F.col("rule_id"))).alias("top_rule"))
    return counts.join(top, "error_type", "left")


def agreement(fired: DataFrame) -> DataFrame:
    """By rule: how often it fired, how often the type derived again is the one it claims,
    and what it most often is instead. ``fired`` has rule, error_type, derived_type."""
    same = F.col("error_type") == F.col("derived_type")
    counts = fired.groupBy("rule").agg(F.count("*").alias("fired"), F.count_if(same).alias("agreed"))
    other = fired.where(~same).groupBy("rule", "derived_type").agg(F.count("*").alias("n"))
    top = other.groupBy("rule").agg(F.min_by("derived_type", F.struct(-F.col("n"), F.col("derived_type"))).alias("instead"))
    return counts.join(top, "rule", "left")
