"""Softened equality of corrections, and one-to-one scores under it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_compound, tokens, typographic
from .kernels import nfc

# Parts of speech that are a matter of wording, and what the place governs.
CONTENT = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
GOVERNED = ("Number", "Case", "Tense", "Mood", "Person", "Degree")

_KEY = ["sid", "start", "end"]


def folded(text: Column) -> Column:
    """A text composed (NFC) and folded. Texts of ASCII alone skip the Python worker's work."""
    return typographic(nfc(text))


def equivalent(gold: Column, system: Column, compounds: bool = True) -> Column:
    """Whether a composed text may stand for another: alike, alike when folded, or one
    compound closed and hyphenated. Null is equal to nothing."""
    same = (gold == system) | (typographic(gold) == typographic(system))
    return F.coalesce(same | same_compound(gold, system) if compounds else same, F.lit(False))


def same_inflection(a: Column, b: Column) -> Column:
    """Whether two parsed tokens agree in what their place governs, where both have it."""
    out = F.lit(True)
    for f in GOVERNED:
        x, y = a["morph"][f], b["morph"][f]
        out = out & F.coalesce(x == y, F.lit(True))
    return out


def same_shape(a: Column, b: Column) -> Column:
    """Whether two parses have the same content words' classes in order, inflected alike
    where the words differ."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    fits = lambda p: F.coalesce((p["x"]["pos"] == p["y"]["pos"]) & p["x"]["pos"].isin(*CONTENT) & ((p["x"]["text"] == p["y"]["text"]) | same_inflection(p["x"], p["y"])), F.lit(False))
    return F.coalesce((F.size(a) > 0) & (F.size(a) == F.size(b)), F.lit(False)) & F.forall(pairs, fits)


def synonymous(pairs: DataFrame, synonyms: DataFrame, gold_parse: str = "gold_parse", system_parse: str = "system_parse") -> DataFrame:
    """``pairs`` (with an ``id``) whose parses are of one shape and whose differing words are
    linked, by form or lemma, by an edge (word, synonym). Edges are joined by equality, so
    the thesaurus may be of any size."""
    shaped = pairs.where(same_shape(F.col(gold_parse), F.col(system_parse)))
    each = shaped.select("id", F.posexplode(F.arrays_zip(F.col(gold_parse).alias("g"), F.col(system_parse).alias("s"))).alias("k", "p"))
    names = lambda t: F.array_distinct(F.array(F.lower(t["text"]), F.lower(t["lemma"])))
    asked = each.where(F.col("p.g.text") != F.col("p.s.text")).select("id", "k", names(F.col("p.g")).alias("gs"), names(F.col("p.s")).alias("ss"))
    edges = asked.select("id", "k", F.explode("gs").alias("word"), "ss").select("id", "k", "word", F.explode("ss").alias("synonym"))
    linked = edges.join(synonyms.select("word", "synonym").distinct(), ["word", "synonym"], "left_semi").select("id", "k").distinct()
    missing = asked.join(linked, ["id", "k"], "left_anti").select("id").distinct()
    return shaped.join(missing, "id", "left_anti")


def one_to_one(candidates: DataFrame) -> DataFrame:
    """Pairs (sid, start, end, system_ordinal, gold_ordinal) of candidates such that no edit
    is in two: in the order of the system's edits, each takes the first gold edit left.
    A group is one span of one sentence."""
    pairs = F.array_sort(F.collect_list(F.struct("system_ordinal", "gold_ordinal")))
    held = candidates.groupBy(*_KEY).agg(pairs.alias("pairs"))
    kind = "array<struct<system_ordinal:int,gold_ordinal:int>>"
    free = lambda got, x, f: ~F.exists(got, lambda g: g[f] == x[f])
    step = lambda got, x: F.when(free(got, x, "system_ordinal") & free(got, x, "gold_ordinal"), F.array_append(got, x)).otherwise(got)
    taken = F.aggregate(F.col("pairs").cast(kind), F.array().cast(kind), step)
    return held.select(*_KEY, F.explode(taken).alias("p")).select(*_KEY, "p.*")


def _by_span(gold: DataFrame, system: DataFrame, compounds: bool) -> DataFrame:
    """``lenient_join`` without synonyms: the edits of a span meet once, and all else is
    found among them. A null in the span meets nothing of the other side."""
    kind = "array<struct<ordinal:int,text:string,type:string,gold:boolean>>"

    def side(edits: DataFrame, is_gold: bool) -> DataFrame:
        edit = F.struct(F.col("ordinal").cast("int").alias("ordinal"), nfc(F.col("correction")).alias("text"), F.col("error_type").alias("type"), F.lit(is_gold).alias("gold"))
        known = F.col("sid").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
        return edits.select(*_KEY, F.when(~known, is_gold).alias("apart"), edit.alias("x"))

    def firsts(own: Column) -> Column:
        # in the order of ordinals: the first of equal texts
        before = lambda i, x: F.exists(F.slice(own, 1, i), lambda y: y["text"].eqNullSafe(x["text"]))
        return F.when(F.size(own) < 2, own).otherwise(F.filter(own, lambda x, i: ~before(i, x)))

    held = side(gold, True).unionByName(side(system, False)).groupBy(*_KEY, "apart").agg(F.array_sort(F.collect_list("x")).cast(kind).alias("all"))
    split = F.transform(F.array("all"), lambda a: F.struct(*[F.transform(F.array(F.filter(a, lambda x: x["gold"] == g)), firsts)[0].alias(n) for g, n in ((True, "g"), (False, "s"))]))
    row = lambda g, s: F.struct(g.alias("gold_type"), s.alias("system_type"))
    none = F.lit(None).cast("string")
    without = lambda own, other: F.filter(own, lambda x: ~F.exists(other, lambda y: F.coalesce(y["text"] == x["text"], F.lit(False))))
    of = lambda own, text: F.filter(own, lambda y: F.coalesce(y["text"] == text, F.lit(False)))
    parted = F.transform(split, lambda b: F.struct(
        F.flatten(F.transform(b["g"], lambda x: F.transform(of(b["s"], x["text"]), lambda y: row(x["type"], y["type"])))).alias("exact"),
        without(b["g"], b["s"]).alias("g"), without(b["s"], b["g"]).alias("s"),
    ))
    pair = "array<struct<s:int,g:int>>"

    def take(b: Column) -> Column:
        def step(got: Column, i: Column) -> Column:
            y = F.get(b["s"], i)
            free = F.filter(F.transform(b["g"], lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda x: ~F.exists(got, lambda p: p["g"] == x["k"]) & equivalent(x["x"]["text"], y["text"], compounds))
            return F.when(F.size(free) > 0, F.array_append(got, F.struct(i.alias("s"), F.get(free, F.lit(0))["k"].alias("g")))).otherwise(got)

        places = F.transform(b["s"], lambda y, i: i)
        return F.when((F.size(b["s"]) > 0) & (F.size(b["g"]) > 0), F.aggregate(places, F.array().cast(pair), step)).otherwise(F.array().cast(pair))

    def told(b: Column) -> Column:
        return F.transform(F.array(take(b)), lambda p: F.concat(
            b["exact"], F.transform(p, lambda x: row(F.get(b["g"], x["g"])["type"], F.get(b["s"], x["s"])["type"])),
            F.transform(F.filter(b["g"], lambda x, k: ~F.exists(p, lambda q: q["g"] == k)), lambda x: row(x["type"], none)),
            F.transform(F.filter(b["s"], lambda x, k: ~F.exists(p, lambda q: q["s"] == k)), lambda x: row(none, x["type"])),
        ))[0]

    return held.select(*_KEY, F.explode_outer(F.transform(parted, told)[0]).alias("r")).where("r is not null").select(*_KEY, "r.*")


def lenient_join(gold: DataFrame, system: DataFrame, compounds: bool = True, synonyms: DataFrame | None = None) -> DataFrame:
    """Gold and system edits (sid, start, end, correction, error_type, ordinal; for the
    synonyms also ``parse``) joined outright: exact pairs first, then those of a span
    whose corrections are equivalent, one to one. Rows: sid, start, end, gold_type,
    system_type. Of equal edits on a side the first counts."""
    if synonyms is None:
        return _by_span(gold, system, compounds)
    key = [*_KEY, "correction"]
    more = ["parse"]

    def side(edits: DataFrame, name: str) -> DataFrame:
        edits = edits.withColumn("correction", nfc(F.col("correction")))
        own = [F.min_by(c, "ordinal").alias(f"{name}_{n}") for c, n in (("error_type", "type"), *((c, c) for c in more))]
        return edits.groupBy(*key).agg(F.min("ordinal").cast("int").alias(f"{name}_ordinal"), *own)

    joined = side(gold, "gold").join(side(system, "system"), key, "full_outer")
    exact = joined.where("gold_ordinal is not null and system_ordinal is not null")
    left = joined.where("system_ordinal is null").select(*_KEY, F.col("correction").alias("gold_text"), "gold_ordinal", "gold_type", *[f"gold_{c}" for c in more])
    right = joined.where("gold_ordinal is null").select(*_KEY, F.col("correction").alias("system_text"), "system_ordinal", "system_type", *[f"system_{c}" for c in more])
    met = left.join(right, _KEY)
    soft = met.where(equivalent(F.col("gold_text"), F.col("system_text"), compounds))
    if synonyms is not None:
        rest = met.where(~equivalent(F.col("gold_text"), F.col("system_text"), compounds))
        rest = rest.withColumn("id", F.struct(*_KEY, "gold_ordinal", "system_ordinal"))
        soft = soft.unionByName(synonymous(rest, synonyms).drop("id"))
    pairs = one_to_one(soft)
    found = pairs.join(left.select(*_KEY, "gold_ordinal", "gold_type"), [*_KEY, "gold_ordinal"]).join(right.select(*_KEY, "system_ordinal", "system_type"), [*_KEY, "system_ordinal"])
    columns = [*_KEY, "gold_type", "system_type"]
    none = F.lit(None).cast("string")
    missed = left.join(pairs, [*_KEY, "gold_ordinal"], "left_anti").select(*_KEY, "gold_type", none.alias("system_type"))
    false = right.join(pairs, [*_KEY, "system_ordinal"], "left_anti").select(*_KEY, none.alias("gold_type"), "system_type")
    return exact.select(*columns).unionByName(found.select(*columns)).unionByName(missed).unionByName(false)


def matches(gold: Column, edit: Column, lenient: bool = True) -> Column:
    """Whether an edit is one of the gold edits, or has the span of one whose correction is
    equivalent to its own."""
    same = lambda g: (g["start"] == edit["start"]) & (g["end"] == edit["end"])
    return F.exists(gold, lambda g: same(g) & (equivalent(g["correction"], edit["correction"]) if lenient else g["correction"] == edit["correction"]))


def unchanged(source: Column, hypothesis: Column) -> Column:
    """Whether two texts have the same tokens; spacing never counts."""
    return tokens(source) == tokens(hypothesis)
