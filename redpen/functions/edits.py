"""Edits as arrays of structs over token spans, handled by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

EDIT = "struct<start:int,end:int,error_type:string,correction:string,annotator:int,required:string,comment:string>"


def is_noop(e: Column) -> Column:
    return (e["start"] == -1) & (e["end"] == -1)


def is_insertion(e: Column) -> Column:
    return ~is_noop(e) & (e["start"] == e["end"])


def is_deletion(e: Column) -> Column:
    return ~is_noop(e) & (e["start"] < e["end"]) & (e["correction"] == "")


def correction_tokens(e: Column) -> Column:
    return F.when(is_noop(e) | is_deletion(e), F.array().cast("array<string>")).otherwise(tokens(e["correction"]))


def edits_for(edits: Column, annotator: int = 0, noops: bool = False) -> Column:
    """One annotator's edits in the order of (start, end), stored order among equals."""
    own = F.filter(edits, lambda e: (e["annotator"] == annotator) if noops else (e["annotator"] == annotator) & ~is_noop(e))
    keyed = lambda o: F.array_sort(F.transform(o, lambda e, i: F.struct(e["start"].alias("s"), e["end"].alias("t"), i.alias("i"))))
    # held in an array of one, the edits are found once
    return F.transform(F.array(own), lambda o: F.transform(keyed(o), lambda k: F.get(o, k["i"])))[0]


def is_correct(edits: Column, annotator: int = 0) -> Column:
    """Whether an annotator has no edit but noops."""
    return F.size(edits_for(edits, annotator)) == 0


def source(words: Column) -> Column:
    """The sentence of its tokens."""
    return F.array_join(words, " ")


def annotators(edits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(edits, lambda e: e["annotator"])))


def overlapping(ordered: Column) -> Column:
    """Whether any edit begins before an earlier one ends; touching is no overlap."""
    state = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("upto"), F.lit(False).alias("bad")),
        lambda s, e: F.struct(F.greatest(s["upto"], e["end"]).alias("upto"), (s["bad"] | (e["start"] < s["upto"])).alias("bad")),
    )
    return state["bad"]


def _fitting(ordered: Column) -> Column:
    """The edits that don't begin before the last one of them ended."""
    kind = "array<int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("skipped"))
    numbered = F.transform(ordered, lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), i.alias("i")))

    def step(s: Column, e: Column) -> Column:
        return F.when(e["start"] < s["at"], F.struct(s["at"].alias("at"), F.array_append(s["skipped"], e["i"]).alias("skipped"))).otherwise(F.struct(e["end"].alias("at"), s["skipped"].alias("skipped")))

    skipped = F.transform(F.array(F.aggregate(numbered, start, step)["skipped"]), lambda k: F.when(F.size(k) == 0, ordered).otherwise(F.filter(ordered, lambda e, i: ~F.array_contains(k, i))))
    return skipped[0]


def apply(words: Column, ordered: Column, strict: bool = True) -> Column:
    """The corrected tokens. ``strict`` raises on overlaps; otherwise an edit that begins
    before the last one ended is skipped. Every edit gives what stands between the one before
    and itself, and its correction; these are put together once."""

    def corrected(b: Column) -> Column:
        w, own = b["w"], b["e"]
        ended = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        parts = F.transform(own, lambda e, i: F.concat(F.slice(w, ended(i) + 1, F.greatest(e["start"] - ended(i), F.lit(0))), correction_tokens(e)))
        return F.concat(F.flatten(parts), F.slice(w, ended(F.size(own)) + 1, F.size(w)))

    def whole(b: Column) -> Column:
        out = corrected(b)
        return F.when(overlapping(b["e"]), F.raise_error(F.lit("edits overlap")).cast("array<string>")).otherwise(out) if strict else out

    # held in arrays of one, words and edits are found once
    held = F.transform(F.array(ordered), lambda e: F.struct(words.alias("w"), (e if strict else _fitting(e)).alias("e")))
    return F.transform(held, whole)[0]


#: Tokens whose offsets are summed up in one go. An array is copied for each value it gains,
#: so long ones grow by blocks.
_BLOCK = 64


def token_spans(words: Column) -> Column:
    """(start, end) character offsets of each token in the text joined by spaces."""
    part = lambda a, b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)

    def within(sizes: Column, begin: Column) -> Column:
        state = F.aggregate(
            sizes,
            F.struct(begin.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("start"), (s["at"] + n - 1).alias("end"))).alias("out")),
        )
        return state["out"]

    def blocks(sizes: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / _BLOCK).cast("int") - 1), lambda b: total(part(sizes, b)))
        begins = F.aggregate(
            sums,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        )["out"]
        return F.flatten(F.transform(begins, lambda at, b: within(part(sizes, b), at)))

    def spans(sizes: Column) -> Column:
        return F.when(F.size(sizes) <= _BLOCK, within(sizes, F.lit(0))).otherwise(blocks(sizes))

    # held in an array of one, the sizes are found once
    return F.transform(F.array(F.transform(words, lambda w: F.char_length(w) + 1)), spans)[0]


def occurrences(words: Column, window: Column) -> Column:
    """How often a token window stands in a token array."""
    places = F.filter(F.sequence(F.lit(1), F.size(words) - F.size(window) + 1), lambda i: F.slice(words, i, F.size(window)) == window)
    return F.when((F.size(words) < F.size(window)) | (F.size(window) == 0), 0).otherwise(F.size(places))


def to_block(words: Column, edits: Column) -> Column:
    """One annotated block, edits in stored order."""
    line = lambda e: F.concat(F.lit("A "), F.concat_ws("|||", F.concat_ws(" ", e["start"], e["end"]), e["error_type"], e["correction"], e["required"], e["comment"], e["annotator"].cast("string")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("S "), F.array_join(words, " "))), F.transform(edits, line)), "\n")


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def f_score(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    """F-beta; 0 where undefined."""
    p, r, b = precision(tp, fp), recall(tp, fn), beta * beta
    return F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))
