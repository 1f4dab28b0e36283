"""Corpus statistics, token histograms, coverage and layers."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens


#: Characters of a piece where no tokenizer is plugged in.
PIECE = 3


def pieces(word: Column) -> Column:
    """The pieces of a word where no tokenizer is plugged in: PIECE characters each, the last
    one perhaps shorter, so all of the word is in them."""
    begins = F.sequence(F.lit(1), F.greatest(F.char_length(word), F.lit(1)), F.lit(PIECE))
    return F.transform(begins, lambda i: F.substring(word, i, F.lit(PIECE)))


class Tokenizer(Protocol):
    """What a tokenizer plugged in must do, on executors too (it is pickled)."""

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without begin, end or other special tokens."""

    def vocabulary(self) -> dict[str, int]: ...

    def special_ids(self) -> list[int]: ...


class FileTokenizer:
    """A tokenizer file of the tokenizers library (``.json``) or of SentencePiece (``.model``),
    loaded where it is used."""

    def __init__(self, path: str):
        self.path = path
        self._held = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_held": None}

    def _library(self):
        if self._held is None:
            if self.path.endswith(".model"):
                import sentencepiece

                self._held = sentencepiece.SentencePieceProcessor(model_file=self.path)
            else:
                import tokenizers

                self._held = tokenizers.Tokenizer.from_file(self.path)
        return self._held

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        if self.path.endswith(".model"):
            return self._library().encode(texts, num_threads=1)
        return [e.ids for e in self._library().encode_batch(texts, add_special_tokens=False)]

    def vocabulary(self) -> dict[str, int]:
        held = self._library()
        return {held.id_to_piece(i): i for i in range(held.vocab_size())} if self.path.endswith(".model") else held.get_vocab()

    def special_ids(self) -> list[int]:
        held = self._library()
        if self.path.endswith(".model"):
            return [i for i in range(held.vocab_size()) if held.is_control(i) or held.is_unknown(i)]
        return [i for i, t in held.get_added_tokens_decoder().items() if t.special]


def encoded(rows: DataFrame, text: str, tokenizer: Tokenizer) -> DataFrame:
    """``rows`` with ``ids``, the tokens of the text column; of a null text none."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenizer.encode_batch(texts.fillna("").tolist()))

    return rows.withColumn("ids", ids(F.col(text)))


def _pieces_of(rows: DataFrame, tokenizer: Tokenizer | None) -> DataFrame:
    if tokenizer is not None:
        return encoded(rows, "sentence", tokenizer)
    return rows.withColumn("ids", F.flatten(F.transform(tokens(F.col("sentence")), pieces)))


def statistics(rows: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Sentences, words, characters, bytes and tokens by language, with the words' mean
    tokens (weighted by words, whatever the corpus), and characters and bytes a token. Without a tokenizer,
    words are cut to pieces."""
    rows = _pieces_of(rows, tokenizer)
    out = rows.groupBy("lang").agg(
        F.count("*").alias("sentences"),
        F.sum(F.size(tokens(F.col("sentence")))).alias("words"),
        F.sum(F.char_length("sentence")).alias("chars"),
        F.sum(F.octet_length("sentence")).alias("bytes"),
        F.sum(F.size("ids")).alias("tokens"),
    )
    return out.withColumn("fertility", F.round(F.try_divide("tokens", "words"), 6))


def per_token(stats: DataFrame) -> DataFrame:
    """The statistics with characters and bytes a token; 0 where there are none."""
    share = lambda c: F.coalesce(F.try_divide(c, "tokens"), F.lit(0.0))
    return stats.withColumns({"chars_per_token": share("chars"), "bytes_per_token": share("bytes")})


def split_rate(rows: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """The share of words that take more than one token, as words within a sentence, a space
    before them. Distinct words are weighed by their counts, so each is tokenised once."""
    words = rows.select("lang", F.explode(tokens(F.col("sentence"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    if tokenizer is None:
        words = words.withColumn("parts", F.size(pieces(F.col("w"))))
    else:
        words = encoded(words.withColumn("_spaced", F.concat(F.lit(" "), "w")), "_spaced", tokenizer).withColumn("parts", F.size("ids"))
    out = words.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("n"))), F.lit(0)).alias("split_words"), F.sum("n").alias("words"))
    return out.withColumn("rate", F.round(F.try_divide("split_words", "words"), 6))


def histogram(rows: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Counts (token, n) of all tokens of all sentences: ids as strings, or pieces."""
    return _pieces_of(rows, tokenizer).select(F.explode("ids").alias("id")).groupBy(F.col("id").cast("string").alias("token")).agg(F.count("*").alias("n"))


def merged(*histograms: DataFrame) -> DataFrame:
    """One histogram of several."""
    whole = histograms[0]
    for h in histograms[1:]:
        whole = whole.unionByName(h)
    return whole.groupBy("token").agg(F.sum("n").alias("n"))


def protected(vocabulary: DataFrame, specials: list[int]) -> DataFrame:
    """Rows (token, id) of a vocabulary that every trim must keep: the special ones, and the
    stand-ins of single bytes, ``<0xNN>`` or a letter of the byte-level alphabet."""
    plain = "!-~\\x{a1}-\\x{ac}\\x{ae}-\\x{ff}"
    byte = F.col("token").rlike("^<0x[0-9A-Fa-f]{2}>$") | F.col("token").rlike(f"^[{plain}\\x{{100}}-\\x{{143}}]$")
    return vocabulary.where(byte | F.col("id").isin(specials) if specials else byte)


def _ranked(hist: DataFrame) -> DataFrame:
    """The histogram with the mass before each token, most frequent first. One window over
    a vocabulary, which is small and doesn't grow with the corpus."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "token").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


def _within(hist: DataFrame, threshold: Column) -> Column:
    return F.col("before") < threshold * F.col("total")


def coverage(hist: DataFrame, thresholds: tuple[float, ...], keep: DataFrame | None = None) -> DataFrame:
    """How many tokens stay at each share of the mass: the most frequent, as long as what
    stands before one is below the share, and those in ``keep`` (column ``token``)."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    kept = _ranked(hist).withColumn("threshold", each).where(_within(hist, F.col("threshold"))).select("threshold", "token")
    if keep is not None:
        always = keep.select("token").withColumn("threshold", each)
        kept = kept.unionByName(always.select("threshold", "token")).distinct()
    return kept.groupBy("threshold").agg(F.count("*").alias("kept"))


def remap(hist: DataFrame, threshold: float, keep: DataFrame | None = None, order: Column | None = None) -> DataFrame:
    """New ids, from 0 in the order of the tokens (or ``order``), of those that coverage keeps."""
    kept = _ranked(hist).where(_within(hist, F.lit(threshold))).select("token")
    if keep is not None:
        kept = kept.unionByName(keep.select("token")).distinct()
    return kept.select("token", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("token") if order is None else order)) - 1).alias("new_id"))


def trim_plan(mapping: DataFrame, original: int) -> DataFrame:
    """What a mapping leaves: the new size, how many rows go, and their share."""
    out = mapping.agg(F.count("*").alias("new_size"))
    return out.withColumn("removed", F.lit(original) - F.col("new_size")).withColumn("share_removed", F.coalesce(F.try_divide("removed", F.lit(original)), F.lit(0.0)))


def trim_rows(weights: DataFrame, mapping: DataFrame) -> DataFrame:
    """The rows of an embedding table (token, vector) that stay, by their new ids."""
    return weights.join(mapping, "token").select("new_id", "vector")


def prune(layers: DataFrame, start: int, count: int) -> DataFrame:
    """Layers (``layer``) without ``count`` of them from ``start`` on, numbered anew."""
    kept = layers.where((F.col("layer") < start) | (F.col("layer") >= start + count))
    return kept.withColumn("layer", F.when(F.col("layer") < start, F.col("layer")).otherwise(F.col("layer") - count))


def embedding_params(vocab_size: Column, hidden: Column, tied: Column) -> Column:
    """Parameters of a model's embeddings, twice as many if they aren't tied."""
    return vocab_size * hidden * F.when(tied, 1).otherwise(2)


def spec_from_config(config: Column) -> Column:
    """(vocab_size, hidden, layers, tied) of a model's JSON configuration, those of its text
    part where it has one."""
    own = "vocab_size bigint, hidden_size bigint, num_hidden_layers bigint, tie_word_embeddings boolean"
    c = F.from_json(config, f"{own}, text_config struct<{own.replace(' bigint', ':bigint').replace(' boolean', ':boolean')}>")
    pick = lambda f: F.coalesce(c["text_config"][f], c[f])
    return F.struct(pick("vocab_size").alias("vocab_size"), pick("hidden_size").alias("hidden"), pick("num_hidden_layers").alias("layers"), F.coalesce(pick("tie_word_embeddings"), F.lit(False)).alias("tied"))


def projection(kept: DataFrame, vocab_size: int, hidden: int, params: int, tied: bool, bytes_per_param: int) -> DataFrame:
    """What a model saves if only the kept rows of its embeddings stay."""
    per_row = hidden * (1 if tied else 2)
    out = kept.withColumn("removed", F.lit(vocab_size) - F.least("kept", F.lit(vocab_size)))
    out = out.withColumn("params_saved", F.col("removed") * per_row)
    return out.withColumn("fraction_saved", F.round(F.col("params_saved") / params, 9)).withColumn("bytes_saved", F.col("params_saved") * bytes_per_param)


#: Ids of a block in which the next one is found.
BLOCK = 1 << 16


def with_next(ids: DataFrame, column: str) -> DataFrame:
    """Ids with the next one (``after``), null of the last. Blocks of ids are sorted apart;
    the last one of a block goes on to the least id of the next block that has any."""
    blocks = ids.select(column, F.floor(F.col(column) / BLOCK).alias("block"))
    heads = blocks.groupBy("block").agg(F.min(column).alias("head"))
    follows = heads.select("block", F.lead("head").over(Window.partitionBy(F.lit(1)).orderBy("block")).alias("next_head"))
    inner = F.lead(column).over(Window.partitionBy("block").orderBy(column))
    return blocks.withColumn("inner", inner).join(follows, "block").select(column, F.coalesce("inner", "next_head").alias("after"))


def layer_similarity(vectors: DataFrame, layers: int = 24) -> DataFrame:
    """Mean cosine of each vector and the next, by layer (the id modulo ``layers``)."""
    order = with_next(vectors.select("vec_id"), "vec_id").where("after is not null")
    nxt = vectors.select(F.col("vec_id").alias("after"), F.col("embedding").alias("b"))
    pairs = vectors.select("vec_id", F.col("embedding").alias("a")).join(order, "vec_id").join(nxt, "after")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cosine = F.try_divide(dot("a", "b"), F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    return pairs.groupBy((F.col("vec_id") % layers).alias("layer")).agg(F.round(F.avg(cosine), 6).alias("similarity"))


def best_window(series: DataFrame, k: int) -> DataFrame:
    """The k consecutive layers of the highest mean, neither edge layer among them; the
    first of equal ones."""
    one = Window.partitionBy(F.lit(1))
    w = one.orderBy("layer").rowsBetween(0, k - 1)
    rows = series.select(F.col("layer").alias("start"), F.round(F.avg("similarity").over(w), 6).alias("mean"), F.count("*").over(w).alias("k"), F.min("layer").over(one).alias("lo"), F.max("layer").over(one).alias("hi"))
    rows = rows.where((F.col("k") == k) & (F.col("start") > F.col("lo")) & (F.col("start") + k - 1 < F.col("hi")))
    return rows.orderBy(F.desc("mean"), "start").limit(1).select("start", "mean")
