"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BARE, PieceModel, chunk_of, words_of
from .common import map_texts

#: Words that a worker keeps; the memo starts anew when it is full.
MEMO_WORDS = 600_000

_models: dict[str, tuple[PieceModel, dict[str, int]]] = {}
_SPACED = re.compile(" *[^ ]+| +$")


def _model(path: str) -> tuple[PieceModel, dict[str, int]]:
    if path not in _models:
        _models[path] = PieceModel(path), {}
    return _models[path]


def count_words(path: str, words: list[str]) -> np.ndarray:
    """Tokens of words that are marked as words_of marks them; each is merged once
    while the memo holds it."""
    model, memo = _model(path)
    new = [w for w in words if w not in memo]
    if new:
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = words
        memo.update(zip(new, model.counts([chunk_of(w).replace(" ", model.SPACE) for w in new]).tolist(), strict=True))
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def count_texts(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text. A text is one space (the dummy prefix) and itself, cut
    before every run of spaces and around line feeds; no piece joins what a cut parts."""
    model = _model(path)[0]
    out = np.zeros(len(texts), np.int64)
    texts = pc.replace_substring(texts, PieceModel.SPACE, " ")  # the model can't tell them apart
    # a text with two spaces together, or at either end, is cut by the pattern instead
    rough = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    for mark in (BARE, " \n", *("\n" if model.joins("\n") else "")):
        rough = pc.or_(rough, pc.match_substring(texts, mark))
    plain = pc.invert(rough).to_numpy(zero_copy_only=False)
    kept = texts.filter(pa.array(plain))
    if len(kept):
        # the dummy prefix is a space, so the first word isn't bare: its own count follows
        sizes, distinct, place = words_of(kept)
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        values = count_words(path, words)[place]
        ends = np.cumsum(sizes)
        heads = ends - sizes
        firsts = [words[k][1:] for k in place[heads]]
        values[heads] = _first_words(path, firsts)
        sums = np.r_[0, np.cumsum(values)]
        filled = pc.binary_length(kept).to_numpy(zero_copy_only=False) > 0
        out[plain] = (sums[ends] - sums[heads]) * filled
    for i in np.flatnonzero(~plain):
        text = texts[int(i)].as_py()
        if text:
            chunks = _SPACED.findall(" " + text)
            at = {c: k for k, c in enumerate(dict.fromkeys(chunks))}
            per = model.counts([c.replace(" ", model.SPACE) for c in at])
            out[i] = per[[at[c] for c in chunks]].sum()
    return out


def _first_words(path: str, firsts: list[str]) -> np.ndarray:
    distinct = list(dict.fromkeys(firsts))
    values = dict(zip(distinct, count_words(path, distinct).tolist(), strict=True))
    values[""] = 1  # the prefix alone, before a line feed
    return np.array([values[w] for w in firsts], np.int64)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, n_bytes, n_tokens, over_limit.

    Counts equal SentencePiece's ``encode`` without begin or end; special strings in
    texts are ordinary text. Null text is empty (0 tokens); a null id stays null;
    repeated rows give repeated rows; an empty table gives an empty one; other columns
    are not read. Pre-tokens of a slice of about 4 MB are ragged arrays in which every
    sequence takes its lowest-rank pair at once; nothing is shuffled."""

    def per_slice(batch: pa.RecordBatch, texts: pa.Array) -> dict:
        return {
            id_col: batch.column(0),
            "n_bytes": pc.binary_length(texts).cast(pa.int64()),
            "n_tokens": count_texts(model_path, texts),
        }

    kind = docs.schema[id_col].dataType.simpleString()
    counted = map_texts(docs, per_slice, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint", id_col, text_col)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
