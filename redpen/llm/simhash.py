"""SimHash near-duplicates: pivot distance tables over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, map_texts, mix64, written

#: Blocks of a fingerprint and how many of them two linked ones share: at most 3
#: differing bits leave 3 of 6 blocks untouched.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Words of 64 row numbers (16 bytes each) up to which a selection of rows is broadcast.
BROADCAST_WORDS = 1 << 20


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of a text: words apart from ASCII white space, A-Z lower-cased, hashed in
    windows of ``width`` (all words, if fewer; 0 without words)."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = (ends - np.fromiter(map(len, words), np.int64, n)).tolist()
    ends = ends.tolist()
    k = min(width, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins, ends[k - 1 :], strict=False)), np.uint64, n - k + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id and ``fp`` (the 64 bits as a signed long)."""

    def per_slice(batch: pa.RecordBatch, texts: pa.Array) -> dict:
        prints = [fingerprint(t.encode(), width) for t in texts.to_numpy(zero_copy_only=False)]
        return {id_col: batch.column(0), "fp": np.array(prints, np.uint64).view(np.int64)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, per_slice, f"`{id_col}` {kind}, fp bigint", id_col, text_col)


def _pivots(words: int) -> np.ndarray:
    """Fixed reference fingerprints, spread by a fixed generator."""
    return np.random.default_rng(64).integers(0, 2**64 - 1, (PIVOTS, words), np.uint64)


def _forest(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each key, as (member, root) row numbers.

    ``prints`` has a row of 64-bit words for each member. The pairs of a key are
    compared by the pivot table first, as the maximum difference of any coordinate;
    what it leaves is verified on the bits. A key whose members are all connected needs
    no more pairs."""
    order = np.lexsort((*prints.T, keys))
    same = np.r_[keys[order[1:]] == keys[order[:-1]], False] if len(order) else np.zeros(0, bool)
    order = order[same | np.r_[False, same[:-1]]] if len(order) else order
    keys, prints = keys[order], prints[order]
    n = len(keys)
    root = np.arange(n)
    if not n:
        return order, order
    table = np.stack([np.bitwise_count(prints ^ p).sum(1, dtype=np.int16) for p in _pivots(prints.shape[1])], 1)
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[begins, n])
    group = np.repeat(np.arange(len(begins)), sizes)
    left = (begins + sizes)[group] - np.arange(n) - 1  # members after each in its key

    def find(x: np.ndarray) -> np.ndarray:
        while (root[x] != x).any():
            root[x] = root[root[x]]
            x = root[x]
        return x

    step, alive = 1, np.flatnonzero(left >= 1)
    while len(alive):
        near = alive
        for p in range(0, PIVOTS, 4):
            near = near[(np.abs(table[near, p : p + 4] - table[near + step, p : p + 4]) <= bits).all(1)]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]).sum(1, dtype=np.int64) <= bits]
        a, b = near, near + step
        while len(a):
            ra, rb = find(a), find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        if step & (step - 1) == 0:
            top = find(np.arange(n))
            parted = np.minimum.reduceat(top, begins) != np.maximum.reduceat(top, begins)
            alive = alive[parted[group[alive]]]
        step += 1
        alive = alive[left[alive] >= step]
    top = find(np.arange(n))
    moved = np.flatnonzero(top != np.arange(n))
    return order[moved], order[top[moved]]


def links(prints: DataFrame, bits: int = 3, column: str = "fp") -> DataFrame:
    """Links between distinct fingerprints at ``bits`` or fewer differing bits, at most
    3: rows (a, b) that connect the same fingerprints as all links do.

    Each fingerprint goes to the 20 choices of 3 of its 6 blocks, at least one of which
    two linked ones share. Within a choice's key a pivot table discards pairs and the
    bits verify; only a spanning forest of each key leaves, so the output is linear."""
    if bits > 3:
        raise ValueError("the blocks find links of at most 3 bits")
    starts = np.cumsum((0, *BLOCKS[:-1])).tolist()
    masks = []
    for chosen in combinations(range(len(BLOCKS)), 3):
        m = sum(((1 << BLOCKS[b]) - 1) << starts[b] for b in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keyed = prints.select(F.col(column).alias("fp")).distinct()
    keyed = keyed.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in masks])).alias("choice", "part"))
    keyed = keyed.select("fp", F.xxhash64("choice", "part").alias("key"))
    # a key's hash may join strangers; they fail the verification

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            fp, key = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = _forest(key, fp.view(np.uint64)[:, None], bits)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return keyed.repartition("key").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The least node of each node's component: rows (node, root), for nodes with edges.

    Alternates large-star and small-star steps (each a minimum per node and a join)
    until nothing changes; every step is written to the shared folder, and removed when
    the next one is."""
    spark = edges.sparkSession
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        drop_written(now, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "small")
        drop_written(large, least)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, ``fingerprint`` (16 hexadecimal digits),
    ``component_id`` (the least id that links reach) and ``n_links`` (other distinct
    fingerprints in the component).

    Null text is empty and has fingerprint zero, linked like any other; null ids stay
    null and name no component unless it has none else; repeated rows stay; an empty
    table gives no rows; other columns are not read. Copies share a fingerprint and
    never meet as pairs."""
    prints = written(fingerprints(docs, width, id_col, text_col), "prints")
    roots = components(links(prints, bits))
    known = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    known = known.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    known = written(known, "known")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"), (F.count("*") - 1).alias("n_links"))
    classes = written(known.join(written(named, "named"), "root").select("fp", "component_id", "n_links"), "classes")
    out = prints.join(classes, "fp")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


#: For similarity on word shingles: bits of the long fingerprint, minima of a text and
#: the keys they give; texts of similarity s share a key with probability
#: 1 - (1 - s ** 3) ** KEYS, over 0.99998 at 0.8.
WORDS, MINIMA, KEYS = 4, 16, 16


def _shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct word shingles of a text, hashed, in order."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    joined = b" ".join(words)
    k = min(width, n)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip((ends - sizes).tolist(), ends[k - 1 :].tolist(), strict=False)), np.uint64, n - k + 1))


def _long_prints(text: bytes, width: int) -> tuple[int | None, bytes, list[int]]:
    """The hash of a text's set of word shingles, a 256-bit SimHash of it, and the keys
    of its minima."""
    h = _shingles(text, width)
    if not len(h):
        return None, b"", []
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 1 << 13):
        part = h[i : i + (1 << 13)]
        wide = np.stack([part, *(mix64(part + np.uint64(0x9E3779B97F4A7C15 * j % 2**64)) for j in range(1, WORDS))], 1)
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    wide = np.packbits(counts * 2 > len(h), bitorder="little").tobytes()
    # the least hash in each of MINIMA classes of hashes; an empty class takes the next one's
    shuffled = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    least = np.full(MINIMA, 2**64 - 1, np.uint64)
    np.minimum.at(least, (shuffled % np.uint64(MINIMA)).astype(np.int64), shuffled // np.uint64(MINIMA))
    empty = least == np.uint64(2**64 - 1)
    if empty.any():
        full = np.flatnonzero(~empty)
        after = full[np.searchsorted(full, np.flatnonzero(empty)) % len(full)]
        least[empty] = mix64(least[after] + np.flatnonzero(empty).astype(np.uint64))
    turns = np.arange(KEYS)
    keys = mix64(least[turns % MINIMA] + mix64(least[(turns + 3) % MINIMA] + mix64(least[(turns + 8) % MINIMA] + turns.astype(np.uint64))))
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64)), wide, keys.view(np.int64).tolist()


def _bits_for(similarity: float) -> int:
    """Differing bits of long fingerprints within which texts of this similarity lie,
    but for six standard deviations: the angle of equal-length sets, per bit."""
    from math import acos, ceil, pi, sqrt

    p = acos(2 * similarity / (1 + similarity)) / pi
    n = 64 * WORDS
    return ceil(n * p + 6 * sqrt(n * p * (1 - p)))


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each group of near-duplicates: that
    of the least id (null last).

    Texts are linked if the Jaccard similarity of their sets of ``width``-word shingles
    is ``similarity`` or more. Candidates share a key of three least shingles, and their
    256-bit SimHashes differ in no more bits than such texts' do, but for six standard
    deviations; within what candidates connect, the sets decide each link. Shorter texts have one shingle, all their words; texts
    without words are all kept, null text among them. Repeated rows are copies. An
    empty table stays empty; columns of any other name pass through."""
    own = {id_col: "__id", text_col: "__text"}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    rows = written(rows, "rows")

    def per_slice(batch: pa.RecordBatch, texts: pa.Array) -> dict:
        got = [_long_prints(t.encode(), width) for t in texts.to_numpy(zero_copy_only=False)]
        return {own[id_col]: batch.column(0), "node": [g[0] for g in got], "fp": [g[1] for g in got], "keys": [g[2] for g in got], "rid": batch.column(2)}

    texts = rows.select(F.col("row")[id_col].alias(own[id_col]), F.col("row")[text_col].alias(own[text_col]), "rid")
    kind = docs.schema[id_col].dataType.simpleString()
    prints = map_texts(texts, per_slice, f"__id {kind}, node bigint, fp binary, keys array<bigint>, rid bigint", own[id_col], own[text_col], also=("rid",))
    prints = written(prints.where("node is not null"), "prints")
    # equal sets have equal prints and keys: one row speaks for a node
    speakers = written(prints.groupBy("node").agg(F.min("rid").alias("rid")), "speakers")
    near = components(_long_links(_picked(prints, speakers), _bits_for(similarity)))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct()
    near = written(near.join(speakers, "node").select("rid", "node", "root"), "near")
    edges = _verified(_picked(texts, near).select("rid", own[text_col]).join(near, "rid").select("node", "root", own[text_col]), width, similarity)
    roots = components(edges)
    classes = prints.select("__id", "rid", F.col("node").alias("fp")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    classes = written(classes.select("__id", "rid", F.coalesce("root", "fp").alias("root")), "classes")
    drop_written(prints, speakers, near)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("rid").alias("r"))).alias("m"))
    first = written(first.select("root", F.col("m.r").alias("keep")), "first")
    gone = written(classes.join(first, "root").where("rid <> keep").select("rid"), "gone")
    drop_written(classes, first)
    return _picked(rows, gone, among=False).select("row.*")


def _picked(rows: DataFrame, rids: DataFrame, among: bool = True) -> DataFrame:
    """The ``rows`` whose rid is among ``rids`` (or isn't), which must be written. Rids
    become bits of words of 64, up to BROADCAST_WORDS of them broadcast, so rows stay
    where they are; more are joined."""
    words = rids.groupBy(F.shiftright("rid", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(rid & 63))")).alias("bits"))
    words = written(words, "words")
    if words.count() > BROADCAST_WORDS:
        drop_written(words)
        return rows.join(rids.select("rid"), "rid", "left_semi" if among else "left_anti")
    held = rows.join(F.broadcast(words), F.shiftright("rid", 6) == F.col("word"), "left")
    return held.where(F.coalesce(F.getbit("bits", F.expr("int(rid & 63)")), F.lit(0).cast("tinyint")) == int(among)).select(*rows.columns)


def _verified(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect the nodes of each ``root`` as all pairs of the similarity
    do, from rows (node, root, text). Texts are smaller than their sets, so they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, members in groupby(rows, lambda row: row[1]):
            nodes, sets = zip(*((node, _shingles(t.encode(), width)) for node, _, t in members), strict=True)
            a, b = _similar(list(sets), similarity)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in a], pa.int64()), pa.array([nodes[i] for i in b], pa.int64())], names=["a", "b"])

    return texts.repartition("root").sortWithinPartitions("root").mapInArrow(run, "a bigint, b bigint")


def _similar(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets with at least this Jaccard similarity."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    places: dict[int, list[int]] = {}
    for i, h in enumerate(sets):
        for x in h.tolist():
            places.setdefault(x, []).append(i)
    held = {x: np.array(p) for x, p in places.items() if len(p) > 1}
    left = np.ones(len(sets), bool)
    kept = len(sets)
    a, b = [], []
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue and left.any():
            i = queue.pop()
            found = [held[x] for x in sets[i].tolist() if x in held]
            if not found:
                continue
            common = np.bincount(np.concatenate(found), minlength=len(sets))
            near = np.flatnonzero(left & (common >= similarity * (sizes + sizes[i] - common) - 1e-9))
            left[near] = False
            a += [i] * len(near)
            b += near.tolist()
            queue += near.tolist()
            if 2 * np.count_nonzero(left) < kept:  # those that are linked need no more comparing
                kept = np.count_nonzero(left)
                held = {x: p for x, p in ((x, p[left[p]]) for x, p in held.items()) if len(p)}
    return a, b


def _long_links(distinct: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between nodes (node, fp, keys) that share a key, within ``bits``. Most
    keys are one node's; only those of several are dealt with their prints."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if len(b)]
        if held:
            node, key = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            order = order[np.r_[same, False] | np.r_[False, same]]
            yield pa.RecordBatch.from_arrays([pa.array(node[order]), pa.array(key[order])], names=["node", "key"])

    keyed = distinct.select("node", F.explode("keys").alias("key")).repartition("key").mapInArrow(shared, "node bigint, key bigint")
    keyed = written(keyed, "keys").join(distinct.select("node", "fp"), "node").select("node", "fp", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()) for b in batches]
        if held:
            node = np.concatenate([h[0] for h in held])
            words = np.frombuffer(b"".join(x for h in held for x in h[1]), np.uint64).reshape(-1, WORDS)
            a, b = _forest(np.concatenate([h[2] for h in held]), words, bits)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return keyed.repartition("key").mapInArrow(run, "a bigint, b bigint").distinct()
