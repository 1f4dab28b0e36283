"""Windows of tokens that a corpus repeats: rolling hashes, anchors, and exact counting.

A window's anchor is its k-mer of least hash; equal windows have equal anchors at equal
places, so only windows whose anchor stands twice in the corpus can repeat. Those alone
are compared."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, slices, texts_of, written

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PLACE = np.uint64((1 << 24) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        one = lambda b: np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
        held = _powers[base] = one(base), one(pow(base, -1, 1 << 64))
    return held


def window_hashes(codes: np.ndarray, k: int, base: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive codes, a polynomial modulo 2**64, mixed."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up[:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[: n - k + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def anchors(codes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchors of a text, the first and last start of the windows that
    each one anchors, and its own place."""
    count = len(codes) - window + 1
    if count < 1:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    h = window_hashes(codes, k, BASES[0])
    at = np.arange(len(h), dtype=np.uint64)
    least = sliding_least((h & ~PLACE) | (at & PLACE), window - k + 1) & PLACE
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    place = first + ((least[first] - first.astype(np.uint64)) & PLACE).astype(np.int64)
    return h[place], first, np.r_[first[1:], count] - 1, place


def bucketed(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` as a table (rid, text, row) bucketed by the row number ``rid`` in the
    shared warehouse, so that later joins by ``rid`` leave the texts in place. ``row``
    holds the other columns; null text is empty."""
    spark = docs.sparkSession
    n = partitions(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*others).alias("row") if others else F.struct(F.lit(0).alias("_")).alias("row"))
    table = f"redpen_{name}_{uuid.uuid4().hex}"
    rows.repartition(n, "rid").write.bucketBy(n, "rid").option("compression", "zstd").format("parquet").saveAsTable(table)
    atexit.register(_drop, spark, table)
    return spark.table(table)


def _drop(spark, table: str) -> None:
    try:
        spark.sql(f"drop table if exists {table}")
    except Exception:  # the session may be gone
        pass


def repeated_anchors(table: DataFrame, codes_of: Callable[[str], np.ndarray], window: int, k: int, fields: tuple[str, ...] = ("first", "last")) -> DataFrame:
    """For each text with anchors that stand twice or more: rid and ``spans``, structs of
    the fields: first, last, at, anchor, n; n counts the anchor's places in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(texts):
                rid = batch.column(0).slice(a, b - a).to_numpy()
                got = [anchors(codes_of(t), window, k) for t in texts.slice(a, b - a).to_numpy(zero_copy_only=False)]
                sizes = [len(g[0]) for g in got]
                h, first, last, at = (np.concatenate([g[j] for g in got]) for j in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid, sizes)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["rid", "first", "last", "at", "anchor"])

    places = table.select("rid", "text").mapInArrow(run, "rid bigint, first int, last int, at int, anchor bigint")
    places = written(places.select("rid", "anchor", *[c for c in ("first", "last", "at") if c in fields]), "anchors")
    counts = written(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    return places.join(counts, "anchor").groupBy("rid").agg(F.collect_list(F.struct(*fields)).alias("spans"))


def starts_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the closed ranges."""
    sizes = last - first + 1
    ends = np.cumsum(sizes)
    return np.repeat(first, sizes) + np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def local_repeats(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a slice repeat within it, and which windows speak for their hash."""
    order = np.lexsort((h2, h1))
    same = np.r_[False, (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])] if len(order) else np.zeros(0, bool)
    twice = np.zeros(len(h1), bool)
    twice[order[same | np.r_[same[1:], False]]] = True
    speaks = np.zeros(len(h1), bool)
    speaks[order[~same]] = True
    return twice, speaks


def runs(rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in the order of (rid, start), joined to runs of consecutive starts."""
    head = np.r_[True, (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1)] if len(rid) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    return rid[at], start[at], np.diff(np.r_[at, len(rid)])


ASK = "h1 bigint, h2 bigint, rid bigint, start int, n int"


def questions(rid: np.ndarray, start: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    """Rows of ASK for the windows of a slice, in the order of (rid, start): each hash
    asks once (n is 0, or -1 where it repeats in the slice); what the slice itself
    answers goes as runs of n windows. So a hash that a third of all texts have is at
    most one row for each slice."""
    twice, speaks = local_repeats(h1, h2)
    ask = np.flatnonzero(speaks)
    r, s, n = runs(rid[twice], start[twice])
    known = mix64(r.astype(np.uint64) + s.astype(np.uint64))
    columns = (
        np.r_[h1[ask], known].view(np.int64),
        np.r_[h2[ask], np.zeros(len(r), np.uint64)].view(np.int64),
        np.r_[rid[ask], r],
        np.r_[start[ask], s].astype(np.int32),
        np.r_[-twice[ask].astype(np.int32), n.astype(np.int32)],
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "rid", "start", "n"])


def answers(asked: DataFrame) -> DataFrame:
    """Runs (rid, start, n) of repeated windows: hashes that two slices ask for, or one
    that saw it twice, and the runs that slices knew. Rows are sorted by hash in each
    partition and read as a stream of which the last row alone is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_hit = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)], False
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            told = columns[4] > 0
            h1, h2, rid, start, n = (np.r_[x, c[~told]] for x, c in zip(last, columns, strict=True))
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            hit = np.r_[same, False][: len(h1)] | np.r_[False, same][: len(h1)]
            if last_hit and len(hit):
                hit[0] = True
            last, last_hit = [x[-1:] for x in (h1, h2, rid, start, n)], bool(len(hit) and hit[-1])
            found = np.flatnonzero(hit[:-1] & (n[:-1] == 0))
            yield _found(np.r_[columns[2][told], rid[found]], np.r_[columns[3][told], start[found]], np.r_[columns[4][told], np.ones(len(found), np.int32)])
        if last_hit and last[4][0] == 0:
            yield _found(last[2], last[3], np.ones(1, np.int32))

    return asked.repartition("h1").sortWithinPartitions("h1", "h2").mapInArrow(run, "rid bigint, start int, n int")


def _found(rid: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start), pa.array(n)], names=["rid", "start", "n"])


def covered(size: int, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of ``size`` tokens lie in the windows of the runs."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0
