"""The clean-corpus funnel, splits, leaks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_clean, normalise, tokens
from . import samples


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, lang, sentence): trimmed lines that aren't empty, pos from 0 over all lines."""
    rows = docs.select(F.col(id_col).alias("doc_id"), "lang", F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return rows.select("doc_id", "pos", "lang", F.trim("line").alias("sentence")).where("sentence <> ''")


def _winners(rows: DataFrame, key: Column, order: tuple[str, ...]) -> DataFrame:
    """The first row's place of each key, by partial minima; keys meet by their MD5 digest,
    so no text is shuffled."""
    first = rows.groupBy(F.unhex(F.md5(key)).alias("digest")).agg(F.min(F.struct(*order)).alias("first"))
    return first.select("first.*", F.lit(True).alias("won"))


def first_of_key(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """``rows`` with their key ``k`` and whether each is its key's first. Rows are joined
    with the winners' places, which are unique, so a key that a third of the rows share
    meets in no single task."""
    out = rows.withColumn("k", key).join(_winners(rows, key, order), list(order), "left")
    return out.withColumn("is_first", F.coalesce("won", F.lit(False))).drop("won")


def misspelled(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Places (doc_id, pos) of sentences with a lower-case alphabetic word of two letters or
    more that isn't in the vocabulary (column ``word``). A capitalised one may be a name."""
    words = F.array_distinct(F.filter(tokens(F.col("sentence")), lambda w: w.rlike("(?U)^\\p{L}{2,}$") & (w == F.lower(w)) & (w != F.upper(w))))
    asked = rows.select("doc_id", "pos", F.explode(words).alias("word"))
    return asked.join(vocabulary.select("word").distinct(), "word", "left_anti").select("doc_id", "pos").distinct()


def is_complete(parse: Column, language: str = "de") -> Column:
    """Whether a parsed sentence is a whole main clause: it has a finite verb, and its first
    token isn't a conjunction that the root governs. Nothing of a null or empty parse."""
    finite = (lambda t: t["tag"].isin("VVFIN", "VAFIN", "VMFIN")) if language == "de" else (lambda t: F.coalesce(t["morph"]["VerbForm"] == "Fin", F.lit(False)))
    first = F.get(parse, F.lit(0))
    stranded = (first["pos"] == "SCONJ") & (F.get(parse, first["head"])["dep"] == "ROOT")
    return F.coalesce(F.exists(parse, finite) & ~stranded, F.lit(False))


#: Reasons in the order in which they are told; the last is none.
REASONS = ("duplicate", "held out", "unclean", "length", "misspelled", "fragment", "kept")


def funnel(rows: DataFrame, held_out: DataFrame, language: str = "de", least: int = 8, most: int = 60, vocabulary: DataFrame | None = None) -> DataFrame:
    """Each sentence with the reason it goes, or ``kept``, the first that fits of REASONS:
    its key stands before, is held out (``held_out`` has texts whose keys mustn't be trained
    on), it isn't clean, too short or long, has an unknown word (with a ``vocabulary``), is
    no whole clause (with a column ``complete``).

    The later tests run over first rows alone; held-out keys are joined with the winners,
    whose keys are unique."""
    key = normalise(F.col("sentence"))
    parsed = ["complete"] if "complete" in rows.columns else []
    keyed = first_of_key(rows, key, "doc_id", "pos")
    held = held_out.select(F.unhex(F.md5(normalise(F.col("text")))).alias("digest")).distinct().withColumn("held", F.lit(True))
    firsts = keyed.where("is_first").withColumn("digest", F.unhex(F.md5("k"))).join(held, "digest", "left").drop("digest")
    if vocabulary is not None:
        firsts = firsts.join(misspelled(firsts, vocabulary).withColumn("wrong", F.lit(True)), ["doc_id", "pos"], "left")
    size = F.size(tokens(F.col("sentence")))
    reason = F.when(F.col("held"), "held out").when(~is_clean(F.col("sentence"), language), "unclean").when((size < least) | (size > most), "length")
    reason = reason.when(F.col("wrong"), "misspelled") if vocabulary is not None else reason
    reason = reason.when(~F.coalesce("complete", F.lit(False)), "fragment") if parsed else reason
    columns = ("doc_id", "pos", "lang", "sentence")
    out = firsts.select(*columns, F.col("k").alias("key"), reason.otherwise("kept").alias("reason"))
    return out.unionByName(keyed.where("not is_first").select(*columns, F.col("k").alias("key"), F.lit("duplicate").alias("reason")))


def funnel_counts(judged: DataFrame) -> DataFrame:
    """How many sentences each reason takes, in the order of REASONS; 0 of unseen ones."""
    names = judged.sparkSession.createDataFrame([(k, r) for k, r in enumerate(REASONS)], "step int, reason string")
    counts = judged.groupBy("reason").agg(F.count("*").alias("n"))
    return names.join(counts, "reason", "left").select("step", "reason", F.coalesce("n", F.lit(0)).alias("n")).orderBy("step")


def correct_sentences(rows: DataFrame, size: int, seed: str, language: str = "de", vocabulary: DataFrame | None = None, least: int = 8, most: int = 30) -> DataFrame:
    """``size`` sentences without errors, to measure overcorrection on; raises if fewer are
    left. Here the filter comes before the dedup, and the key keeps white space."""
    fine = rows.where(is_clean(F.col("sentence"), language))
    fine = first_of_key(fine, F.lower("sentence"), "doc_id", "pos").where("is_first").drop("is_first", "k")
    words = F.size(tokens(F.col("sentence")))
    fine = fine.where((words >= least) & (words <= most))
    if vocabulary is not None:
        fine = fine.join(misspelled(fine, vocabulary), ["doc_id", "pos"], "left_anti")
    keyed = fine.withColumn("_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")))
    return samples.at_least(keyed, seed, "_key", size).drop("_key")


def spelled_correctly(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows all of whose checked words are in the vocabulary."""
    return rows.join(misspelled(rows, vocabulary), ["doc_id", "pos"], "left_anti")


def stratified(rows: DataFrame, bucket: Column, size: int, salt: str, key: str) -> DataFrame:
    """A seeded sample of ``size`` rows in the proportions of the buckets, null among them."""
    return samples.screen(rows, size, salt, key, bucket)


def held_out_share(rows: DataFrame, salt: str, key: str, percent: int) -> DataFrame:
    """A holdout by hash: rows stay on the side they fall on as the table grows."""
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("bigint") % 100
    return rows.withColumn("side", F.when(share < percent, "held").otherwise("train"))
