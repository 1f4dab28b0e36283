"""Suffix-array deduplication over bytes: blockwise suffix sorting with a difference cover."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, texts_of, written
from .repeats import ASK, BASES, answers, bucketed, covered, questions, repeated_anchors, runs, starts_of, window_hashes

#: Bytes of an anchor within a window.
ANCHOR = 64
#: Contexts of one bucket that one task sorts together, 3 MB at most. An anchor that stands
#: more often is split to buckets of windows that begin within STEP places of each other,
#: by all the bytes these have in common; one that is still larger, window by window.
BUCKET, STEP = 4096, 42
#: Bytes of contexts that are sorted at once.
BLOCK = 1 << 20
PERIOD = 16

_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def byte_codes(text: str) -> np.ndarray:
    return _BYTES[np.frombuffer(text.encode(), np.uint8)]


def difference_cover(period: int) -> np.ndarray:
    """Residues among whose differences is every residue: 0..r and the multiples of r,
    for the root r of the period."""
    r = int(period**0.5)
    return np.unique(np.r_[np.arange(r + 1), np.arange(0, period, r)])


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples, equal ones alike."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        step[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, window: int) -> np.ndarray:
    """A class number for each start, equal where the next ``window`` bytes are.

    ``text`` is padded by PERIOD bytes at least; equal windows lie at equal residues of
    PERIOD and in one bucket. Suffixes of a bucket are sorted by their first PERIOD bytes;
    ties go by the rank of the cover position that follows within PERIOD bytes, ranked
    once by doubling over multiples of PERIOD, and by the window's last bytes, which
    that rank may not reach."""
    reach = window - PERIOD
    if reach < PERIOD or reach % PERIOD:
        raise ValueError("the window isn't a multiple of the period, three at least")
    eight = np.lib.stride_tricks.sliding_window_view(text, 8).copy().view(">u8").ravel().astype(np.uint64)
    last = len(eight) - 9
    cover = difference_cover(PERIOD)
    sample = np.flatnonzero(np.isin(np.arange(last + 1) % PERIOD, cover))
    slot = np.full(last + 1 + window, -1, np.int64)
    slot[sample] = np.arange(len(sample))
    rank = _ranks(eight[sample], eight[sample + 8])
    length = PERIOD

    def behind(by: int) -> np.ndarray:
        at = slot[sample + by]
        return np.where(at >= 0, rank[at], -1)

    while length * 2 <= reach:
        rank = _ranks(rank, behind(length))
        length *= 2
    if length < reach:
        rank = _ranks(rank, behind(reach - length))
    to_cover = np.array([min((c - r) % PERIOD for c in cover) for r in range(PERIOD)])
    residue = starts % PERIOD
    tie = rank[slot[starts + to_cover[residue]]]
    end = starts + reach
    return _ranks(bucket, eight[starts], eight[starts + 8], residue, tie, eight[end], eight[end + 8])


def sorted_block(contexts: list[bytes], ats: np.ndarray, counts: np.ndarray, groups: np.ndarray, flags: np.ndarray, window: int) -> np.ndarray:
    """Which windows of a block repeat: flat over contexts. ``ats`` is each anchor's
    place in its context, ``counts`` the windows in it, ``groups`` the bucket, ``flags``
    whether the context is known to stand twice."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    # each context is laid out with its anchor at a multiple of PERIOD
    begin = np.zeros(len(contexts), np.int64)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        at += (-(at + int(ats[i]))) % PERIOD
        begin[i] = at
        at += n
    text = np.zeros(at + window + 2 * PERIOD, np.uint8)
    for c, b in zip(contexts, begin.tolist(), strict=True):
        text[b : b + len(c)] = np.frombuffer(c, np.uint8)
    starts = starts_of(begin, begin + counts - 1)
    owner = np.repeat(np.arange(len(contexts)), counts)
    kind = equal_windows(text, starts, groups[owner], window)
    weight = np.bincount(kind, minlength=1 + int(kind.max()))
    weight += np.bincount(kind[flags[owner]], minlength=len(weight))
    return weight[kind] > 1


_ROW = "anchor bigint, rid bigint, start int, n int, at int, flag int, context binary"


def repeated_strings(table: DataFrame, window: int) -> DataFrame:
    """Runs (rid, start, n) of byte windows that stand elsewhere too."""
    spans = written(repeated_anchors(table, byte_codes, window, ANCHOR, ("first", "last", "at", "anchor", "n")), "spans")
    some = F.filter("spans", lambda x: x["n"] <= BUCKET)
    many = F.filter("spans", lambda x: x["n"] > BUCKET)
    texts = table.select("rid", "text")
    cold = texts.join(spans.select("rid", some.alias("spans")).where(F.size("spans") > 0), "rid")
    hot = texts.join(spans.select("rid", many.alias("spans")).where(F.size("spans") > 0), "rid")

    def fields(lists: pa.Array) -> tuple[np.ndarray, ...]:
        flat = lists.flatten()
        return (np.cumsum(lists.value_lengths().to_numpy()), *(flat.field(f).to_numpy() for f in ("first", "last", "at", "anchor")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of contexts by their own hashes."""
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            parts = [(np.full(n, rid), start + np.arange(n), *(window_hashes(_BYTES[np.frombuffer(c, np.uint8)], window, x) for x in BASES)) for _, rid, start, n, _, _, c in rows]
            r, at, h1, h2 = (np.concatenate([p[j] for p in parts]) for j in range(4))
            order = np.lexsort((at, r))
            yield questions(r[order], at[order], h1[order], h2[order])

    def split(first: int, last: int, at: int, anchor: int, text: bytes) -> Iterator[tuple[int, int, int]]:
        """The buckets (key, first, last) of a frequent anchor's windows."""
        for group in range((at - last) // STEP, (at - first) // STEP + 1):
            near, far = at - group * STEP, at - group * STEP - STEP + 1
            yield xxhash.xxh64_intdigest(text[near : far + window], group) - (1 << 63), max(first, far), min(last, near)

    def dealing(frequent: bool):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each distinct context of a slice, flagged if it has it twice; and
            runs of windows (flag 2) that the slice so knows to repeat."""
            for batch in batches:
                texts = texts_of(batch, "text")
                for a, b in slices(texts):
                    rid = batch.column(0).slice(a, b - a).to_pylist()
                    ends, *spans = (x.tolist() for x in fields(batch.column(2).slice(a, b - a)))
                    seen: dict[tuple[int, bytes], list] = {}
                    rows: list[tuple] = []
                    for i, t in enumerate(texts.slice(a, b - a).to_numpy(zero_copy_only=False)):
                        text = t.encode()
                        for first, last, at, anchor in zip(*(x[ends[i - 1] if i else 0 : ends[i]] for x in spans), strict=True):
                            for key, s, e in split(first, last, at, anchor, text) if frequent else ((anchor, first, last),):
                                context = text[s : e + window]
                                row = [key, rid[i], s, e - s + 1, at - s, 0, context]
                                if (known := seen.get((key, context))) is None:
                                    seen[(key, context)] = row
                                else:
                                    known[5] = 1
                                    rows.append((rid[i] ^ s, *row[1:4], 0, 2, None))
                    for row in seen.values():
                        if row[5]:
                            rows.append((row[1] ^ row[2], *row[1:4], 0, 2, None))
                        rows.append(tuple(row))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["anchor", "rid", "start", "n", "at", "flag", "context"])

        return deal

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        """Runs of repeated windows of whole buckets. Equal contexts are one for the
        sort; a bucket of one context has nothing to sort, as its windows begin at
        different distances from the anchor."""
        told = [r[1:4] for r in rows if r[5] == 2]
        places: dict[bytes, list[tuple]] = {}
        for r in rows:
            if r[5] != 2:
                places.setdefault(r[6], []).append(r)
        heads, many = [], []
        kinds = Counter(held[0][0] for held in places.values())
        for held in places.values():
            twice = len(held) > 1 or held[0][5] == 1
            if twice:
                told += [r[1:4] for r in held if not r[5]]
            if kinds[held[0][0]] > 1:
                heads.append(held[0])
                many.append(twice)
        rid, start, n = (np.array([r[k] for r in told], np.int64) for k in range(3))
        if heads and not all(many):
            counts = np.array([r[3] for r in heads], np.int64)
            known = np.array(many)
            hit = sorted_block([r[6] for r in heads], np.array([r[4] for r in heads]), counts, np.array([r[0] for r in heads], np.int64), known, window)
            own = np.repeat(np.array([r[1] for r in heads], np.int64), counts)
            first = np.array([r[2] for r in heads], np.int64)
            where = starts_of(first, first + counts - 1)
            fresh = hit & ~np.repeat(known, counts)
            more = runs(own[fresh], where[fresh])
            rid, start, n = (np.r_[x, y] for x, y in zip((rid, start, n), more, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["rid", "start", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of whole buckets, in the order of their anchors."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    if size >= BLOCK:
                        yield settle(held)
                        held, size = [], 0
                held.append(row)
                size += len(row[6] or b"")
        if held:
            yield settle(held)

    split_up = written(hot.mapInArrow(dealing(True), _ROW), "buckets")
    large = written(split_up.where("flag < 2").groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > BUCKET).select("anchor"), "large")
    single = split_up.where("flag < 2").join(large, "anchor", "left_semi").select(*split_up.columns)
    dealt = cold.mapInArrow(dealing(False), _ROW).unionByName(split_up.join(large, "anchor", "left_anti").select(*split_up.columns))
    told = split_up.where("flag = 2").join(large, "anchor", "left_semi").select("rid", "start", "n")  # by chance: these have keys of their own
    sorted_ones = dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, "rid bigint, start int, n int")
    return sorted_ones.unionByName(answers(single.mapInArrow(ask, ASK))).unionByName(told)


def deduplicated(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, n_bytes, n_removed, n_spans and ``kept``, the
    UTF-8 bytes outside every repeated window, as binary (a cut may part a character).

    A window is ``window`` consecutive bytes of one document (a multiple of 16 from 48
    on, above the 64 bytes of an anchor); it repeats if the same bytes also start
    anywhere else, in the same document too. Null text is empty; repeated rows are
    copies of each other; null ids stay; an empty table gives no rows."""
    table = bucketed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "bytes")
    found = repeated_strings(table, window).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(texts):
                lists = batch.column(2).slice(a, b - a)
                flat = lists.flatten()
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
                out = []
                for i, t in enumerate(texts.slice(a, b - a).to_numpy(zero_copy_only=False)):
                    text = np.frombuffer(t.encode(), np.uint8)
                    lo = ends[i - 1] if i else 0
                    drop = covered(len(text), start[lo : ends[i]], n[lo : ends[i]], window)
                    out.append((len(text), int(drop.sum()), int(np.count_nonzero(drop & ~np.r_[False, drop[:-1]])), text[~drop].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(a, b - a), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = table.join(found, "rid", "left").select("rid", "text", "runs", "row")
    kind = table.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.col("row.id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
