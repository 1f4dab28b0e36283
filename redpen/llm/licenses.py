"""License scans: phrases, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and the labels they give.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Characteristic sentences of public licenses and their labels.
TEMPLATES = {
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-or-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    """Words of lower-cased text: runs of ASCII letters and digits and of all else beyond ASCII."""
    return F.array_remove(F.split(text, _BETWEEN), "")


def frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of a vocabulary stands, over all documents: one
    count for each word, so the result is as small as the vocabulary."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    found = docs.select(F.explode(F.array_intersect(_words(text), F.lit(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _template_rows(templates: dict[str, str], threshold: float, counts: dict[str, int]) -> list[tuple]:
    """Label, words from the globally rarest to the most frequent, least overlap, and
    length of the prefix that a match must touch."""
    rows = []
    for label, text in sorted(templates.items()):
        words = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        least = ceil(threshold * len(words) - 1e-9)
        rows.append((label, words, least, len(words) - least + 1))
    return rows


def _places(words: Column, parts: list[str]) -> Column:
    """Where the parts stand consecutively."""

    def here(i: Column) -> Column:
        same = F.get(words, i).eqNullSafe(parts[0])
        for j, part in enumerate(parts[1:], 1):
            same = same & F.get(words, i + j).eqNullSafe(part)
        return same

    return F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)


def _matches(words: Column, templates: dict[str, str], rows: list[tuple]) -> Column:
    """Structs (label, share) of the templates of whose distinct words some window holds
    the threshold. A window is half as long again as the template and begins at every
    word, across line breaks; only texts that have enough of a template's words at all,
    the rarest in its prefix among them, are cut into windows."""

    def one(label: str, kinds: list[str], least: int, prefix: int) -> Column:
        template, width = F.lit(kinds), ceil(1.5 * len(templates[label].split()))
        candidate = F.arrays_overlap(words, F.lit(kinds[:prefix])) & (F.size(F.array_intersect(words, template)) >= least)
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
        best = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(words, i, width), template))))
        share = _let(best, lambda n: F.when(n >= least, F.struct(F.lit(label).alias("label"), (n / len(kinds)).alias("share"))))
        return F.when(candidate, share)

    return F.array_compact(F.array(*[one(*r) for r in rows]))


def scan(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each input row: the id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Phrases are found where their words stand consecutively. A block is a window of
    words half as long again as the template, at every place of the text and across line
    breaks; it matches a template of which it contains at least ``threshold`` of the
    distinct words, exactly. The join runs beside each row, with prefix and length
    filters over words ordered by their frequency in all documents, since the templates
    are few and fixed (nothing is shuffled but the vocabulary's counts).
    ``score`` is 1 for a phrase, else the largest contained share of a matching
    template, else 0. Null text is empty (no words, empty labels, null places); null
    ids and repeated rows stay; an empty table gives no rows."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    counts = frequencies(docs, sorted({w for t in templates.values() for w in t.split()}), text_col)
    rows = _template_rows(templates, threshold, counts)
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    out = docs.select(F.col(id_col), text.alias("low"))
    out = out.select(id_col, "low", _words(F.col("low")).alias("words"))
    out = out.select(id_col, "low", "words", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("joined"))
    places = {}
    for k, (phrase, _) in enumerate(phrases.items()):
        at = _places(F.col("words"), phrase.split())
        places[f"p{k}"] = F.when(F.contains("joined", F.lit(f" {phrase} ")), at).otherwise(F.array().cast("array<int>"))
    touched = F.arrays_overlap("words", F.lit(sorted({w for r in rows for w in r[1][: r[3]]})))
    none = F.array().cast("array<struct<label:string,share:double>>")
    out = out.select(
        id_col,
        F.size("words").cast("bigint").alias("n_words"),
        *[c.alias(n) for n, c in places.items()],
        F.when(touched, _matches(F.col("words"), templates, rows)).otherwise(none).alias("found"),
    )
    every = F.concat(*places)
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    mine = F.transform("found", lambda x: x["label"])
    return out.select(
        id_col,
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, mine))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def scan_sql(threshold: float = 0.8) -> str:
    """DuckDB SQL of ``scan`` over ``documents``."""
    between = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    words = lambda s: f"list_filter(string_split_regex({s}, '{between}'), lambda w: w <> '')"
    hits = []
    for phrase in PHRASES:
        parts = phrase.split()
        same = " and ".join(f"words[i + {j + 1}] = '{w}'" for j, w in enumerate(parts))
        hits.append(f"list_filter(range(0, greatest(len(words) - {len(parts)} + 1, 0)), lambda i: {same})")
    found = []
    for label, words_, least, _ in _template_rows(TEMPLATES, threshold, {}):
        best = f"list_max(list_transform(blocks, lambda b: len(list_intersect(b, {words_!r}))))"
        found.append(f"case when {best} >= {least} then {{'label': '{label}', 'share': {best} / {len(words_)}.0}} end")
    base = ", ".join(f"case when len({h}) > 0 then '{label}' end" for h, label in zip(hits, PHRASES.values(), strict=True))
    return f"""
with d as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as low from documents),
w as (select doc_id, {words("low")} as words, list_transform(string_split(low, chr(10)), lambda l: list_distinct({words("l")})) as blocks from d),
f as (select doc_id, words, list_concat({", ".join(hits)}) as places, list_filter([{base}], lambda x: x is not null) as base,
  list_filter([{", ".join(found)}], lambda x: x is not null) as found from w)
select doc_id, len(words)::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, list_transform(found, lambda x: x.label)))), ','), '') as labels,
  case when len(places) > 0 then 1.0::double else coalesce(list_max(list_transform(found, lambda x: x.share)), 0)::double end as score
from f"""
