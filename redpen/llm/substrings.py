"""Substring deduplication over words: a de Bruijn graph of the k-mers that repeat."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, texts_of, written
from .repeats import BASES, bucketed, covered, repeated_anchors, runs, starts_of, window_hashes

#: Words of an anchor within a k-mer.
ANCHOR = 12
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_codes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


#: An edge that a slice of texts has: a hash of its words, the word before and the word
#: behind it (0: none, or not the same at all places), its first place, and how often the
#: slice has it. Rows of n below 0 are runs of -n edges that the slice knows to repeat.
_EDGE = "edge bigint, before int, behind int, rid bigint, start int, n int"
_LEFT, _RIGHT, _TWICE, _BITS = 1, 2, 4, 8


def _short(hashes: np.ndarray) -> np.ndarray:
    """31 bits of each hash, none of them 0."""
    return ((hashes >> np.uint64(33)) | np.uint64(1)).astype(np.int32)


def _edges_of(rid: np.ndarray, texts: list[str], spans: list[tuple[np.ndarray, np.ndarray]], window: int) -> pa.RecordBatch:
    """Rows of _EDGE for the candidate edges of a slice, one for each distinct edge; the
    others' places, whose outer words are compared too, leave as known runs."""
    parts = []
    for r, t, (first, last) in zip(rid.tolist(), texts, spans, strict=True):
        order = np.argsort(first)
        at = starts_of(first[order].astype(np.int64), last[order].astype(np.int64))
        codes = word_codes(t)
        short = np.r_[_short(mix64(codes)), np.int32(0)]
        before = np.where(at > 0, short[np.maximum(at, 1) - 1], 0)
        hashes = [window_hashes(codes, window, x)[at] for x in BASES]
        parts.append((np.full(len(at), r), at, hashes[0].view(np.int64), hashes[1], before, short[at + window], codes[at], codes[at + window - 1]))
    rids, at, edge, check, before, behind, head, tail = (np.concatenate([p[j] for p in parts]) for j in range(8))
    order = np.lexsort((np.arange(len(at)), check, edge))
    fresh = np.r_[True, (edge[order[1:]] != edge[order[:-1]]) | (check[order[1:]] != check[order[:-1]])] if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    many = np.diff(np.r_[begin, len(order)])
    speaker = order[begin]
    own = speaker[np.cumsum(fresh) - 1]  # the speaker of each edge, in the order of edges
    if len(begin):
        for word in (before, behind):
            differs = np.maximum.reduceat(word[order], begin) != np.minimum.reduceat(word[order], begin)
            word[speaker] = np.where(differs, 0, word[speaker])
    silent = ~fresh & (head[order] == head[own]) & (tail[order] == tail[own])
    told = np.sort(order[silent])
    known, start, n = runs(rids[told], at[told])
    key = np.sort(speaker)
    count = np.zeros(len(at), np.int32)
    count[speaker] = many
    zero = np.zeros(len(known), np.int32)
    columns = (
        np.r_[edge[key], mix64(known.astype(np.uint64) + start.astype(np.uint64)).view(np.int64)],
        np.r_[before[key], zero],
        np.r_[behind[key], zero],
        np.r_[rids[key], known],
        np.r_[at[key], start].astype(np.int32),
        np.r_[count[key], -n.astype(np.int32)],
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["edge", "before", "behind", "rid", "start", "n"])


def _marks(edges: DataFrame) -> DataFrame:
    """Rows (rid, start, n) of repeated edges. Known runs have their length n; any other
    is one edge with n below 0: how often the corpus has it and whether all its places
    have one word before it, one behind it, and whether its own slice has it twice.

    Edges are sorted by their hash in each partition and read as a stream that holds the
    rows of one edge, at most one of each slice of the corpus."""

    def settle(columns: list[np.ndarray]) -> pa.RecordBatch:
        edge, before, behind, rid, start, n = columns
        told, asks = np.flatnonzero(n < 0), np.flatnonzero(n > 0)
        order = asks[np.argsort(edge[asks], kind="stable")]
        if not len(order):
            return pa.RecordBatch.from_arrays([pa.array(rid[told]), pa.array(start[told]), pa.array(-n[told])], names=["rid", "start", "n"])
        begin = np.flatnonzero(np.r_[True, edge[order[1:]] != edge[order[:-1]]])
        size = np.diff(np.r_[begin, len(order)])
        total = np.add.reduceat(n[order].astype(np.int64), begin)
        bits = np.zeros(len(begin), np.int64)
        for word, bit in ((before, _LEFT), (behind, _RIGHT)):
            least, most = (f.reduceat(word[order], begin) for f in (np.minimum, np.maximum))
            bits += bit * ((least == most) & (least != 0))
        twice = n[order] > 1
        code = np.repeat(bits + _BITS * np.minimum(total, 1 << 27), size) + _TWICE * twice
        hit = np.repeat(total > 1, size)
        found = order[hit]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[rid[told], rid[found]]), pa.array(np.r_[start[told], start[found]]), pa.array(np.r_[-n[told], -code[hit].astype(np.int32)])], names=["rid", "start", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if cut:
                yield settle([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield settle(held)

    return edges.repartition("edge").sortWithinPartitions("edge").mapInArrow(run, "rid bigint, start int, n int")


def repeated_paths(table: DataFrame, window: int) -> DataFrame:
    """The compacted de Bruijn graph of what the corpus repeats, by its sources: rows
    (rid, start, n, p1, p2, places, sure), n consecutive edges of a source from word
    ``start`` on.

    Edges are k-mers of ``window`` words between the (k-1)-mers at their ends. Edges
    whose anchor stands once are unique and left out before anything is compared; the
    others meet by their hash, one row for each slice of texts that has them. Two
    consecutive edges of a source are one path if the node between them doesn't branch:
    every place of the first is followed by the second, every place of the second
    preceded by the first. So all places of a path read alike from end to end, and
    ``places`` counts them. p1 and p2 are a hash of the path's words, read at the source's
    coordinates. Rows that are ``sure`` were compared within their slice; p1 is null where
    they are no path's first place there."""
    spans = repeated_anchors(table, word_codes, window, min(ANCHOR, window))
    rows = table.select("rid", "text").join(spans, "rid")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(texts):
                lists = batch.column(2).slice(a, b - a)
                flat = lists.flatten()
                first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
                ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
                held = [(first[x:y], last[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield _edges_of(batch.column(0).slice(a, b - a).to_numpy(), texts.slice(a, b - a).to_numpy(zero_copy_only=False).tolist(), held, window)

    marks = _marks(rows.mapInArrow(ask, _EDGE)).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("marks"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            lists = batch.column(2)
            flat = lists.flatten()
            starts, ns = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            for i, text in enumerate(texts_of(batch, "text").to_numpy(zero_copy_only=False)):
                lo, rid = (ends[i - 1] if i else 0), batch.column(0)[i].as_py()
                start, n = starts[lo : ends[i]], ns[lo : ends[i]]
                told = n > 0
                out += [(rid, s, k, None, None, None, True) for s, k in zip(start[told].tolist(), n[told].tolist(), strict=True)]
                order = np.argsort(start[~told])
                at, code = start[~told][order], -n[~told][order]
                if not len(at):
                    continue
                joins = (at[1:] == at[:-1] + 1) & (code[:-1] & _RIGHT > 0) & (code[1:] & _LEFT > 0)
                head = np.flatnonzero(np.r_[True, ~joins])
                size = np.diff(np.r_[head, len(at)])
                words = text.encode().split()
                for h, k in zip(head.tolist(), size.tolist(), strict=True):
                    s, c = int(at[h]), int(code[h])
                    path = xxhash.xxh128_digest(b" ".join(words[s : s + k + window - 1]))
                    p1, p2 = np.frombuffer(path, np.int64).tolist()
                    out.append((rid, s, k, p1, p2, c // _BITS, bool((code[h : h + k] & _TWICE).all())))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=["rid", "start", "n", "p1", "p2", "places", "sure"])

    walked = table.select("rid", "text").join(marks, "rid").mapInArrow(walk, "rid bigint, start int, n int, p1 bigint, p2 bigint, places int, sure boolean")
    return written(walked, "paths")


def verified(paths: DataFrame) -> DataFrame:
    """Rows (rid, start, n) of ``paths`` whose words stand elsewhere too: compared within
    their slice, or read alike at the coordinates of another slice."""
    alike = paths.where("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("m")).where("m > 1")
    checked = paths.where("not sure").join(alike, ["p1", "p2"], "left_semi")
    return paths.where("sure").select("rid", "start", "n").unionByName(checked.select("rid", "start", "n"))


def compacted(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The repeated paths of ``docs``: one row for each distinct one with its words
    (``text``), n_words, n_places (where it stands, repeats within a document included) and
    the id and first word of one place. Texts PQ, PQ and P give P at 3 places, and what is
    left of PQ, which begins within P, at 2. Nulls, copies and empty tables as in
    ``deduplicated``; a text shorter than a window has no path."""
    table = bucketed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "words")
    paths = repeated_paths(table, window)
    known = paths.where("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("m"), F.max("sure").alias("sure"), F.max("places").alias("n_places"), F.min(F.struct("rid", "start", "n")).alias("at"))
    known = known.where("m > 1 or sure").select("at.rid", F.col("at.start").alias("first_word"), (F.col("at.n") + window - 1).alias("n_words"), F.col("n_places").cast("bigint").alias("n_places"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return table.join(known, "rid").select(F.col("row.id").alias(id_col), "first_word", "n_words", "n_places", F.array_join(F.slice(words, F.col("first_word") + 1, F.col("n_words")), " ").alias("text"))


def _without(table: DataFrame, paths: DataFrame, window: int, joined: bool) -> DataFrame:
    """(row, text, n_words, n_removed) with the words of all paths removed: the kept
    words joined by a space, or the text with the removed stretches cut out."""
    whole = paths.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("paths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(texts):
                lists = batch.column(2).slice(a, b - a)
                flat = lists.flatten()
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
                out, sizes, gone = [], [], []
                for i, t in enumerate(texts.slice(a, b - a).to_numpy(zero_copy_only=False)):
                    text = t.encode()
                    words = text.split()
                    lo = ends[i - 1] if i else 0
                    sizes.append(len(words))
                    if lo == ends[i]:
                        gone.append(0)
                        out.append(b" ".join(words) if joined else text)
                        continue
                    drop = covered(len(words), start[lo : ends[i]], n[lo : ends[i]], window)
                    gone.append(int(drop.sum()))
                    if joined:
                        out.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d]))
                    else:
                        begins = [m.start() for m in _WORD.finditer(text)] + [len(text)]
                        edge = np.flatnonzero(np.diff(np.r_[False, drop, False])).tolist()
                        kept, last = [], 0
                        for s, e in zip(edge[::2], edge[1::2], strict=True):
                            kept.append(text[last : begins[s]])
                            last = begins[e]
                        out.append(b"".join([*kept, text[last:]]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3).slice(a, b - a), pa.array(out, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], names=["row", "text", "n_words", "n_removed"]
                )

    kind = table.schema["row"].dataType.simpleString()
    rows = table.join(whole, "rid", "left").select("rid", "text", "paths", "row")
    return rows.mapInArrow(run, f"row {kind}, text string, n_words bigint, n_removed bigint")


def deduplicated(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, n_words, n_removed and ``kept``, the words
    outside every window that repeats, joined by one space.

    A window is ``window`` consecutive words (apart by ASCII white space, unchanged) of
    one document; it repeats if the same words also start anywhere else, in the same
    document too. Null text has no words; repeated rows are copies of each other and
    lose all words if they have a window; null ids stay; an empty table gives no rows.
    Words are removed where a path of the compacted graph (``repeated_paths``) is verified:
    edges meet by 64 bits of their hash, and 128 bits of the path's words, read at its
    source's coordinates, must stand at another's too. Strangers that share a hash part
    their paths and fail there."""
    table = bucketed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "words")
    out = _without(table, verified(repeated_paths(table, window)), window, True)
    return out.select(F.col("row.id").alias(id_col), "n_words", "n_removed", F.col("text").alias("kept"))


def deduplicated_sql(window: int = 35) -> str:
    """DuckDB SQL for the digest of ``deduplicated`` over ``documents``: windows as strings."""
    return f"""with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, w, unnest(range(len(w) - {window - 1})) as i from d where len(w) >= {window}),
g as (select doc_id, i, array_to_string(w[i + 1:i + {window}], ' ') as words from s),
r as (select doc_id, i from g where words in (select words from g group by words having count(*) > 1)),
x as (select distinct doc_id, i + j as p from r, range({window}) t(j)),
t as (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from d),
k as (select t.doc_id, count(*) as n, string_agg(word, ' ' order by t.p) as kept from t anti join x on t.doc_id = x.doc_id and t.p = x.p group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k on d.doc_id = k.doc_id"""


def cleaned(docs: DataFrame, window: int = 35, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the words of repeated windows cut out of the text;
    what is left keeps its white space. No row goes; a text may become empty, and a
    null text does."""
    table = bucketed(docs, text_col, "words")
    out = _without(table, verified(repeated_paths(table, window)), window, False)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
