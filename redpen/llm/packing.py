"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BARE, ByteModel, chunk_of, words_of
from .common import ragged_arange, slices, texts_of, written

MEMO_WORDS = 400_000
#: Documents that are packed together; each group leaves one sequence short at most.
GROUP_DOCS = 1024
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (a layer's matrices
#: against attention at about a thousand hidden dimensions).
LINEAR, QUADRATIC = 1.0, 1.0 / 6000

_models: dict[str, tuple[ByteModel, dict]] = {}


class _Memo:
    """Words, marked as words_of marks them, with their ids, flat."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.place)
        while n + len(words) > len(self.begin):
            self.begin, self.size = np.r_[self.begin, np.zeros_like(self.begin)], np.r_[self.size, np.zeros_like(self.size)]
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.used += len(ids)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))


def _lookup(path: str, words: list[str]) -> tuple[_Memo, np.ndarray]:
    if path not in _models:
        _models[path] = ByteModel(path), {"memo": _Memo()}
    model, held = _models[path]
    memo = held["memo"]
    new = [w for w in words if w not in memo.place]
    if new:
        if len(memo.place) + len(new) > MEMO_WORDS:
            memo = held["memo"] = _Memo()
            new = words
        memo.add(new, *model.encode_words([chunk_of(w) for w in new]))
    return memo, np.fromiter(map(memo.place.__getitem__, words), np.int64, len(words))


#: Bytes of white space, or of marks used here, that the split at spaces doesn't know;
#: and first bytes of the characters that may be white space beyond ASCII.
_STRANGE = np.isin(np.arange(256), [*BARE.encode(), 0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)])
_WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _unusual(texts: pa.Array) -> pa.Array:
    """Whether each text has white space other than spaces and line feeds, or BARE."""
    texts = pa.concat_arrays([texts])  # offsets from 0
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    has = lambda table: np.diff(np.searchsorted(np.flatnonzero(table[data]), offsets - offsets[0])) > 0
    odd, wide = has(_STRANGE), has(_WIDE)
    if wide.any():
        odd[wide] |= pc.match_substring_regex(texts.filter(pa.array(wide)), _WIDE_SPACE).to_numpy(zero_copy_only=False)
    return pa.array(odd)


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and how many each has, as the tokenizers library gives
    them without added special tokens.

    A text is cut before each space that a non-space follows and around single line
    feeds; the pre-tokenizer always cuts there too. Texts with other white space, or
    with a special token's string, go to the library whole."""
    if path not in _models:
        _models[path] = ByteModel(path), {"memo": _Memo()}
    model = _models[path][0]
    odd = _unusual(texts)
    for a in ("  ", " \n", "\n ", "\n\n", *model.special):
        odd = pc.or_(odd, pc.match_substring(texts, a))
    odd = pc.or_(odd, pc.ends_with(texts, " "))
    plain = pc.invert(odd).to_numpy(zero_copy_only=False)
    sizes, distinct, place = words_of(texts.filter(pa.array(plain)))
    memo, at = _lookup(path, distinct.to_numpy(zero_copy_only=False).tolist())
    row = at[place]
    n = memo.size[row]
    flat = memo.ids[np.repeat(memo.begin[row], n) + ragged_arange(n)]
    ends = np.r_[0, np.cumsum(n)][np.cumsum(sizes)].astype(np.int64)
    lengths = np.zeros(len(texts), np.int64)
    lengths[plain] = np.diff(np.r_[0, ends])
    if plain.all():
        return flat, lengths
    parts, last, k = [], 0, 0
    for i in np.flatnonzero(~plain):
        k = int(plain[:i].sum())
        upto = ends[k - 1] if k else 0
        ids = np.array(model.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
        parts += [flat[last:upto], ids]
        last, lengths[i] = upto, len(ids)
    return np.concatenate([*parts, flat[last:]]), lengths


def _pieces(docs: DataFrame, model_path: str, room: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The ids of every document with ``end_id`` last, as unsigned little-endian 32-bit
    integers, cut after every ``room``: the id, start, length, ids_crc32, doc_tokens, ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text_col)
            for a, b in slices(texts):
                flat, lengths = encode_texts(model_path, texts.slice(a, b - a))
                ends = np.cumsum(lengths) + np.arange(b - a)
                whole = np.full(len(flat) + b - a, end_id, "<u4")
                own = np.ones(len(whole), bool)
                own[ends] = False
                whole[own] = flat
                many = -(-(lengths + 1) // room)
                of, start = np.repeat(np.arange(b - a), many), room * ragged_arange(many)
                size = np.minimum(lengths[of] + 1 - start, room)
                edges = np.r_[0, np.cumsum(size)]
                raw = memoryview(whole.view(np.uint8))
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                ids = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(whole)])
                columns = [batch.column(0).slice(a, b - a).take(pa.array(of)), start, size, np.array(crc, np.int64), lengths[of] + 1, ids]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "ids"])

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents shorter than
    ``room``, packed into ceil(total / room) sequences.

    Documents go from the longest to the shortest, each to the sequence of the lowest
    cost among those with capacity for it; one that fits nowhere is cut over the
    sequences of the most capacity. Ties: the earlier document, the lower sequence."""
    count = -(-sum(lengths) // room)
    free = [room] * count
    fill: list[tuple[float, int]] = [(0.0, s) for s in range(count)]
    pieces = []

    def put(doc: int, start: int, n: int, s: int, price: float) -> float:
        pieces.append((doc, start, n, s, room - free[s]))
        free[s] -= n
        return price + cost(n)

    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        n, tried, placed = lengths[doc], [], False
        while fill:
            price, s = heapq.heappop(fill)
            if free[s] >= n:
                price = put(doc, 0, n, s, price)
                placed = True
                if free[s]:
                    heapq.heappush(fill, (price, s))
                break
            tried.append((price, s))
        if not placed:
            start = 0
            tried.sort(key=lambda x: (-free[x[1]], x[1]))
            rest = []
            for price, s in tried:
                take = min(free[s], n - start)
                if take:
                    price = put(doc, start, take, s, price)
                    start += take
                if free[s]:
                    rest.append((price, s))
            tried = rest
        for x in tried:
            heapq.heappush(fill, x)
    return pieces


def pack(docs: DataFrame, model_path: str, room: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``room`` tokens; one row a piece:
    the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids``
    (binary, little-endian unsigned 32-bit).

    Every whole ``room`` tokens of a document fill a sequence of their own, where the
    document is tokenised. The tails, shorter than ``room``, are packed in groups of about
    GROUP_DOCS, dealt by a hash of id, ids and place, so a group holds GROUP_DOCS * room
    tokens or so however ids and texts are skewed, and however long; each group leaves
    one sequence short at most. Sequence numbers are unique but have gaps. Ties in length
    go by id (null last), then the ids' checksum. Null text is empty and has the end id
    alone; repeated rows are documents of their own; null ids stay null; an empty table
    gives no rows; other columns aren't read."""
    kind = docs.schema[id_col].dataType.simpleString()
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    pieces = written(_pieces(docs, model_path, room, end_id, id_col, text_col), "pieces")
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    full = pieces.where(F.col("length") == room).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("bigint"))
    salt = F.xxhash64(F.col(id_col), "ids_crc32", F.monotonically_increasing_id())
    tails = pieces.where(F.col("length") < room).withColumn("bin", F.pmod(salt, F.lit(groups)))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        missing = rows[id_col].isna()
        rows = rows.iloc[np.lexsort((rows["ids_crc32"], rows[id_col].where(~missing, rows[id_col].dropna().min() if not missing.all() else 0), missing))]
        doc, begin, size, sequence, offset = np.array(assign(rows["length"].tolist(), room), np.int64).reshape(-1, 5).T
        held = rows["ids"].tolist()
        body = [held[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), begin.tolist(), size.tolist(), strict=True)]
        return pd.DataFrame(
            {
                id_col: rows[id_col].iloc[doc].array,
                "start": rows["start"].to_numpy()[doc] + begin,
                "length": size,
                "ids_crc32": [zlib.crc32(b) for b in body],
                "doc_tokens": rows["doc_tokens"].to_numpy()[doc],
                "sequence_id": (int(key[0]) << 32) + sequence,
                "offset": offset,
                "ids": body,
            }
        )

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return full.select(*columns).unionByName(tails.groupBy("bin").applyInPandas(one, schema))
