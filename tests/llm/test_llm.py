"""The training-data operators against brute force, on rows with every hard case."""

from __future__ import annotations

import hashlib
import math
import random
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from redpen.llm import bpe, common, fingerprints, licenses, lm, nbest, packing, quality, simhash, substrings, suffixes, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, row int, id int, bin string, words string"


def _text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "Über", "lanta", "rel", "to,", "né.", "a", "in", "x\n"]) + rng.choice(["", "s", "ing", "éa"]) for _ in range(n))


def _rows():
    """Nulls, empty and long texts, copies, repeated rows, a shared passage, clashing columns."""
    rng = random.Random(3)
    passage = _text(rng, 60)
    long = _text(rng, 3000)
    texts = [None, "", " ", "a", "x\n\ny", long, long + " end", long.replace("the", "thy", 3), passage, "so " + passage + " it goes", _text(rng, 80) + passage]
    texts += [_text(rng, n) for n in (2, 3, 4, 34, 35, 36, 90, 120)] + ["no " * 90, "日本語 テスト 😀", "tab\tand\x0bvt  two  "]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[8], rows[8], (None, passage), (None, None), (200, texts[12]), (200, texts[13])]
    return [(d, t, "en", "s" if (d or 0) % 2 else None, None, "r", 1, 2, "b", "w") for d, t in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(got):
    return sorted(map(repr, got))


def test_fingerprints(docs, rows, empty):
    out = fingerprints.edited_likeness(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((r[0], len(r[1] or "")) for r in rows)
    once = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    expect = {}
    for i, r in enumerate(order):
        nxt = order[(i + 1) % len(order)]
        if r[0] in once and nxt[0] in once:
            t, n = r[1] or "", nxt[1] or ""
            expect[r[0]] = hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in out if r.doc_id in expect} == expect
    by_text = {}
    for r in docs.select("text").distinct().collect():
        by_text[r.text] = None
    prints = fingerprints.fingerprints(docs.withColumn("key", F.coalesce("text", F.lit(""))), "key").collect()
    for r in prints:
        assert by_text.setdefault(("p", r.key), r.fingerprint) == r.fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fingerprints.edited_likeness(empty).count() == 0


def test_order_minhash_minima(spark):
    """Signatures by the definition, in plain Python."""
    text = "a b c a b c a b c d e f g a b c"
    got = spark.range(1).select(fingerprints.order_minhash(F.lit(text)).alias("s")).first().s
    assert len(got) == len({x >> 16 for x in got}) and all(0 <= x >> 16 < 64 for x in got)
    same, other = (spark.range(1).select(fingerprints.likeness(fingerprints.order_minhash(F.lit(text)), fingerprints.order_minhash(F.lit(t))).alias("l")).first().l for t in (text, "g f e d c b a " * 3))
    assert same == 1.0 and other < 0.3


def test_order_counts(spark):
    """The same k-mers in another order are less like."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    halves = " ".join(words[150:] + words[:150])
    like = lambda a, b: spark.range(1).select(fingerprints.likeness(fingerprints.order_minhash(F.lit(a)), fingerprints.order_minhash(F.lit(b))).alias("l")).first().l
    edited = words[:]
    for i in range(0, 300, 60):
        edited[i] = "new"
    assert like(" ".join(words), halves) < 0.75 < 0.8 < like(" ".join(words), " ".join(edited)) + 0.1


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = bpe.PieceModel(path).processor
    expect = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "")), len(library.encode(r[1] or "")) > 4096) for r in rows]
    assert _sorted(map(tuple, token_counts.token_counts(docs, path).collect())) == _sorted(expect)
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_random():
    import pyarrow as pa

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab the▁ in\n 1é日") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a" + " " * k + "b" for k in range(40)]
    library = bpe.PieceModel(path).processor
    assert token_counts.count_texts(path, pa.array(texts, pa.large_string())).tolist() == [len(x) for x in library.encode(texts)]


def _n_best(lattice, text, n):
    """The n best scores by taking every piece at every place."""
    best = [[0.0]]
    for j in range(1, len(text) + 1):
        sums = []
        for i in range(max(0, j - lattice.longest), j):
            part = text[i:j]
            if part in lattice.pieces or j == i + 1:
                price = lattice.pieces[part][1] if part in lattice.pieces else lattice.unknown
                sums += [x + price for x in best[i]]
        best.append(sorted(sums, reverse=True)[:n])
    return best[-1]


def test_nbest(docs, rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lattice = nbest.PieceLattice(path)
    out = nbest.encoded(docs, path).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    by_id = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 200}
    for r in out:
        if r.doc_id in by_id and 0 < len(by_id[r.doc_id] or "") < 400:
            assert np.allclose(r.scores, _n_best(lattice, "▁" + by_id[r.doc_id].replace(" ", "▁"), 3)), by_id[r.doc_id]
    assert nbest.encoded(empty, path).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_nbest_random(n):
    import pyarrow as pa

    path = public_tokenizers.path("piece_bpe_32k.model")
    lattice = nbest.PieceLattice(path)
    rng = random.Random(n)
    parts = ["the", "in", "g", "é", "😀", " ", "  ", "\n", "abra", "▁", "z", "日"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 90))) for _ in range(150)] + ["a" * 200, "😀a" * 90]
    for text, (scores, ids) in zip(texts, nbest.segment(path, pa.array(texts, pa.large_string()), n), strict=True):
        assert np.allclose(scores, _n_best(lattice, "▁" + text.replace(" ", "▁"), n)), text
        assert lattice.decode(ids.tolist()) == text.replace("▁", " ")


@pytest.mark.parametrize("text", ["😀" * 3000, "日本" * 1500, "a😀" * 3000, "日本語" * 333_334, "a" * 10_000], ids=["emoji", "pairs", "mixed", "million", "letter"])
def test_nbest_without_spaces(text):
    import pyarrow as pa

    path = public_tokenizers.path("piece_bpe_32k.model")
    ((scores, ids),) = nbest.segment(path, pa.array([text], pa.large_string()), 3)
    lattice = nbest.PieceLattice(path)
    assert lattice.decode(ids.tolist()) == text
    if len(text) <= 10_000:
        assert np.allclose(scores, _n_best(lattice, "▁" + text, 3))


def test_lm(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = lm.scores(docs, path).collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 != 2:
            counts.update((r[1] or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    expect = Counter()
    for r in rows:
        words = [*(r[1] or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        expect[(r[0], zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expect
    assert all(r.score < 0 for r in out)
    assert lm.scores(empty, path).count() == 0


def test_lm_windows_tile_all_training_texts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = lm._gather(docs.select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("held")), path).collect()
    windows = [np.frombuffer(r.ids, "<u4") for r in found if r.kind == 2]
    assert all(2 <= len(w) <= lm.WINDOW + 1 for w in windows)
    assert Counter(t for w in windows for t in w[1:].tolist()).total() >= sum(r.n for r in found if r.kind == 1) - len(rows)


def test_lm_learns_starts_and_ends(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    size = bpe.ByteModel(path).size
    found = lm._gather(docs.select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("held")), path).collect()
    windows = [np.frombuffer(r.ids, "<u4").tolist() for r in found if r.kind == 2]
    assert sum(w[0] == size + 1 for w in windows) == sum(w[-1] == size for w in windows) == len(rows)
    assert not any(size + 1 in w[1:] or size in w[:-1] for w in windows)
    assert sum(len(w) - 1 for w in windows) == sum(r.n for r in found if r.kind == 1) + len(rows)
    short = spark.createDataFrame([(i, "yes no") for i in range(300)], "doc_id bigint, text string")
    assert lm.scores(short, path).agg(F.avg("score")).first()[0] > -1.0


def _model(seed, vocabulary=500):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, vocabulary)
    start = lm.Attention(counts, 7)
    return lm.Attention(counts, 7, [t + rng.normal(0, 0.1, t.shape).astype(np.float32) for t in start.tensors])


def test_lm_is_a_distribution():
    """Over all subwords and the end, in any context."""
    model = _model(3)
    e, _ = model.encode(np.random.default_rng(1).integers(0, 500, (2, lm.WINDOW)), 0)
    for context in e[:, ::13].reshape(-1, lm.WIDTH):
        every = model.log_probs(np.repeat(context[None], 501, 0), np.arange(501))
        assert math.isclose(np.exp(every).sum(), 1, rel_tol=1e-4)


def test_attention_gradient():
    """The largest elements of each tensor's gradient against differences of the loss."""
    model, rng = _model(0), np.random.default_rng(0)
    x, y = rng.integers(0, 500, (2, 3, lm.WINDOW))
    y[0, 5] = 500
    weight = np.ones(x.shape, np.float32)
    loss = lambda m: -m.log_probs(m.encode(x, 0)[0].reshape(-1, lm.WIDTH), y.ravel()).mean()
    rate = 1e-6
    moved = lm.Attention(np.zeros(500), 7, [t.copy() for t in model.tensors])
    moved.slots = model.slots
    start = [t.copy() for t in model.tensors]
    held = [np.zeros_like(t) for t in model.tensors]
    assert math.isclose(moved.learn(x, y, weight, held, [np.zeros(len(t)) for t in model.tensors], rate), loss(model), rel_tol=1e-4)
    names = "E T t U c Q K V O r A a B".split()
    for i, name in enumerate(names):
        size = np.sqrt(held[i])
        for at in np.argsort(-size.ravel())[:3]:
            ends = []
            for step in (1e-5, -1e-5):
                other = lm.Attention(np.zeros(500), 7, start)
                other.slots = model.slots
                for n, t in zip(names, start, strict=True):
                    setattr(other, n, t.astype(np.float64))
                getattr(other, name).ravel()[at] += step
                ends.append(loss(other))
            went = np.sign((start[i] - moved.tensors[i]).ravel()[at])
            assert math.isclose((ends[0] - ends[1]) / 2e-5, went * size.ravel()[at], rel_tol=1e-3, abs_tol=1e-7), name


def test_lm_far_scores():
    """Scores beyond what exp holds in 32 bits, up or down, give what 64 bits give."""
    model, rng = _model(2), np.random.default_rng(4)
    model.c += 300 * rng.choice([-1, 0, 1], len(model.c)).astype(np.float32)
    model.t -= 200
    e, y = rng.normal(0, 1, (80, lm.WIDTH)).astype(np.float32), rng.integers(0, 501, 80)

    def log_softmax(z, own):
        return z[own] - z.max() - math.log(np.exp(z - z.max()).sum())

    got = model.log_probs(e, y)
    for row, target, log in zip(e.astype(float), y, got, strict=True):
        g, own = divmod(int(model.slots[target]), lm.MEMBERS) if target < 500 else (model.groups, 0)
        at = slice(g * lm.MEMBERS, (g + 1) * lm.MEMBERS)
        expect = log_softmax(model.U @ row + model.c, g) + (log_softmax(model.T[at] @ row + model.t[at], own) if target < 500 else 0)
        assert math.isclose(log, expect, rel_tol=1e-4, abs_tol=1e-3)
    x, y = rng.integers(0, 500, (2, 3, lm.WINDOW))
    zeros = [np.zeros_like(t) for t in model.tensors]
    assert math.isfinite(model.learn(x, y, np.ones(x.shape, np.float32), zeros, [np.zeros(len(t)) for t in zeros], 0.01))
    assert all(np.isfinite(t).all() for t in model.tensors)


def test_lm_tasks_fill_the_cores():
    """A round's tasks run in whole rounds of the cores, each of a few parts."""
    assert [lm._tasks(parts, 6) for parts in (1, 6, 14, 48, 70)] == [1, 6, 6, 6, 12]
    for parts in range(1, 500):
        tasks = lm._tasks(parts, 6)
        assert -(-parts // tasks) <= lm.TASK_PARTS and (tasks == parts or tasks % 6 == 0)


def test_windows_score_each_token_once():
    model = _model(1)
    seq = np.random.default_rng(2).integers(0, 500, 90)
    got = lm.score_sequences(model, seq, np.array([90]))[0]
    total = 0.0
    for t in range(90):
        begin = 0 if t < lm.WINDOW else (t - lm.WINDOW) // lm.STRIDE * lm.STRIDE + lm.STRIDE
        x = np.r_[model.vocabulary + 1, seq][begin : begin + lm.WINDOW]
        e, _ = model.encode(np.pad(x, (0, lm.WINDOW - len(x)))[None], 0)
        total += model.log_probs(e[:, t - begin], seq[t : t + 1])[0]
    assert math.isclose(got, total, rel_tol=1e-4)


def test_lm_beats_the_base(spark):
    """On texts that training hasn't seen, whose words have an order to learn."""
    rng = random.Random(11)
    words = ["".join(rng.choice("bdfklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    follow = {w: rng.sample(words, 3) for w in words}

    def text():
        out = [rng.choice(words)]
        while len(out) < 60:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id bigint, text string")
    row = lm.scores(docs, public_tokenizers.path("byte_bpe_50k.json")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_lm_parts_and_disk(spark, docs, monkeypatch):
    """Parts learn alone from the common start, however tasks hold them, and what training
    wrote is gone once the model is there."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(lm, "TASK_WINDOWS", 40)
    gathered = lm._gather(docs.select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("held")), path)
    windows = gathered.where("kind = 2")
    rows = windows.selectExpr("ids", "k", "pmod(xxhash64(k), 2) AS round").collect()
    parts = -(-len(rows) // 80)
    part = dict(windows.selectExpr("k", f"pmod(hash(k), {parts})").collect())
    assert parts > spark.sparkContext.defaultParallelism  # so that a task holds more than one
    counts = np.arange(bpe.ByteModel(path).size) % 7
    got = lm.train(windows, counts, 30)
    model = lm.Attention(counts, 30)
    for r in range(2):
        moved, learned = [np.zeros(t.shape) for t in model.tensors], [np.zeros(len(t)) for t in model.tensors]
        for p in range(parts):
            own = lm.Attention(counts, 30, [t.copy() for t in model.tensors])
            held, touched = [np.zeros_like(t) for t in own.tensors], [np.zeros(len(t), np.float32) for t in own.tensors]
            ids = [x.ids for x in sorted((x for x in rows if x.round == r and part[x.k] == p), key=lambda x: x.k)]
            for k in range(0, len(ids), lm.BATCH):
                own.learn(*lm._padded(ids[k : k + lm.BATCH], own.vocabulary + 1), held, touched, lm.RATE)
            for i, t in enumerate(own.tensors):
                moved[i] += (t - model.tensors[i]) * touched[i].reshape(-1, *[1] * (t.ndim - 1))
                learned[i] += touched[i]
        for t, m, w in zip(model.tensors, moved, learned, strict=True):
            t += m / np.maximum(w, 1).reshape(-1, *[1] * (m.ndim - 1))
    off = [float((np.abs(x - y) > 1e-3).mean()) for x, y in zip(got.tensors, model.tensors, strict=True)]
    assert max(off) < 0.01, off  # a first step goes by the sign, which rounding decides where a gradient is next to none
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert lm.scores(docs, path).count() == docs.count()
    assert {x.name.split("-")[0] for x in set(folder.iterdir()) - before} == {"counts", "scored"}


def test_frequent_words(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1000, 500, 500, 20, 3, 1, 1])], "k bigint, n bigint")
    assert sorted(r.n for r in lm.frequent(counts, 3).collect()) == [500, 500, 1000]
    assert [r.n for r in lm.frequent(counts, 2).collect()] == [1000] and lm.frequent(counts.limit(0), 2).count() == 0


def _counts(text):
    words = text.encode().split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, rows, empty):
    out = quality.verdicts(docs).collect()
    expect = Counter()
    for r in rows:
        n, *rest = _counts(r[1] or "")
        expect[(r[0], n, *rest, n < 50 or 100 * rest[3] > 50 * n)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == expect
    assert not any(r.kept for r in out if r.base_failed) and any(r.kept for r in out)
    assert quality.verdicts(empty).count() == 0
    assert quality.passing(empty).columns == empty.columns


def test_quality_outliers(spark):
    rng = random.Random(9)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(120)), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join("$$$ ab" for _ in range(5)) + " " + " ".join(f"{w}&&&" for w in clean[i][1].split()), "en", "s") for i in range(30)]
    out = quality.verdicts(spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")).collect()
    assert all(r.kept for r in out if r.doc_id < 1000) and not any(r.kept for r in out if r.doc_id >= 1000)


def test_quality_small_tables(spark):
    """Fewer rows than 200, and a group of few rows whose usual text isn't its language's."""
    rng = random.Random(6)
    line = lambda n, w: " ".join(w + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, line(80, ""), "en", "s") for i in range(60)] + [(100 + i, line(80, "ABCDEF"), "en", "caps") for i in range(40)]
    rows += [(200, line(80, "#*$%&|<>"), "en", "s")]
    out = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not out[200]
    assert sum(out[i] for i in range(60)) >= 57 and sum(out[100 + i] for i in range(40)) >= 38


def test_substrings(docs, rows, empty):
    window = 35
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    grams = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    expect = []
    for d, w in words:
        drop = [False] * len(w)
        for i in range(len(w) - window + 1):
            if grams[tuple(w[i : i + window])] > 1:
                drop[i : i + window] = [True] * window
        expect.append((d, len(w), sum(drop), b" ".join(x for x, y in zip(w, drop, strict=True) if not y).decode()))
    assert _sorted(map(tuple, substrings.deduplicated(docs).collect())) == _sorted(expect)
    assert substrings.deduplicated(empty).count() == 0
    kept = substrings.cleaned(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    by = {r.doc_id: r.text for r in kept.collect()}
    assert {d: by[d].encode().split() for d, *_ in expect if d is not None and d < 200} == {d: t.encode().split() for d, _, _, t in expect if d is not None and d < 200}


def test_compacted_paths(spark):
    p, q = (" ".join(f"{x}{i}" for i in range(50)) for x in "pq")
    docs = spark.createDataFrame([(1, "a " + p), (2, p + " b"), (3, "c d"), (None, None)], "doc_id bigint, text string")
    assert [(r.n_places, r.n_words, r.text) for r in substrings.compacted(docs).collect()] == [(2, 50, p)]
    # a path that another source leaves, or joins, is parted there
    docs = spark.createDataFrame([(1, f"{p} {q}"), (2, f"x {p} {q}"), (3, f"{p} y")], "doc_id bigint, text string").repartition(3)
    assert sorted((r.n_places, r.n_words) for r in substrings.compacted(docs).collect()) == [(2, 84), (3, 50)]
    assert substrings.compacted(docs.limit(0)).count() == 0


def test_compacted_places(spark):
    """Every edge of the repeated paths has the path's number of places, and none is left out."""
    rng = random.Random(4)
    parts = [[f"{x}{rng.randrange(50)}" for _ in range(rng.randint(3, 12))] for x in "abcdefg"]
    texts = [" ".join(w for _ in range(rng.randint(0, 8)) for w in rng.choice(parts)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    grams = Counter(tuple(t.split()[i : i + 6]) for t in texts for i in range(len(t.split()) - 5))
    found = Counter()
    for r in substrings.compacted(docs, window=6).collect():
        words = r.text.split()
        assert len(words) == r.n_words and texts[r.doc_id].split()[r.first_word : r.first_word + r.n_words] == words
        found.update({tuple(words[i : i + 6]): r.n_places for i in range(len(words) - 5)})
    assert found == Counter({g: n for g, n in grams.items() if n > 1})


@pytest.mark.parametrize("bucket", [suffixes.BUCKET, 1], ids=["sorted", "split"])
def test_suffixes(docs, rows, empty, bucket, monkeypatch):
    """With buckets of one context all anchors are split, and what is still alike goes by window."""
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    window = 400
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    expect = []
    for d, t in texts:
        drop = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                drop[i : i + window] = True
        spans = int(np.count_nonzero(drop & ~np.r_[False, drop[:-1]])) if len(t) else 0
        expect.append((d, len(t), int(drop.sum()), spans, np.frombuffer(t, np.uint8)[~drop].tobytes()))
    assert _sorted((*r[:4], bytes(r[4])) for r in suffixes.deduplicated(docs).collect()) == _sorted(expect)
    assert suffixes.deduplicated(empty).count() == 0


def test_difference_cover():
    for period in (4, 16, 64):
        cover = suffixes.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_simhash(docs, rows, empty):
    def fp(text):
        w = text.encode().lower().split()
        if not w:
            return 0
        k = min(3, len(w))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(r[0], fp(r[1] or "")) for r in rows]
    group = {p: p for _, p in prints}
    changed = True
    while changed:
        changed = False
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {}
    for d, p in prints:
        if d is not None:
            least[group[p]] = min(least.get(group[p], d), d)
    expect = [(d, f"{p:016x}", least.get(group[p])) for d, p in prints]
    assert _sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == _sorted(expect)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_lose_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, np.uint64)
    flips = [base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(4)]
    prints = np.unique(np.concatenate(flips))
    a, b = simhash._forest(np.zeros(len(prints), np.int64), prints[:, None], 3)
    root = np.arange(len(prints))
    root[a] = b
    for i in range(len(prints)):
        for j in range(i):
            if int(prints[i] ^ prints[j]).bit_count() <= 3:
                assert root[i] == root[j]


def test_representatives(spark, docs, rows, empty):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(12)]
    near = [b.replace(b.split()[100], "changed", 1) for b in base]
    out = simhash.representatives(spark.createDataFrame(list(enumerate(base + near + base)), "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(12))
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    wordless = sum(not (r[1] or "").encode().split() for r in rows)
    assert kept.where("text is null or text rlike '^[ ]*$'").count() == wordless
    assert simhash.representatives(empty).count() == 0


def test_representatives_verify_similarity(spark):
    """Pairs of 100 shingles on both sides of a Jaccard similarity of 0.8."""
    rng = random.Random(8)
    texts, expect = [], 0
    for pair in range(60):
        common = [f"c{pair}x{rng.random()}" for _ in range(104)]
        changed = (6, 15, 25)[pair % 3]
        texts += [" ".join(common), " ".join(common[: 104 - changed] + [f"d{rng.random()}" for _ in range(changed)])]
        a, b = (set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts[-2:])
        expect += 1 if len(a & b) / len(a | b) >= 0.8 else 2
    out = simhash.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert out.count() == expect == 100


def test_licenses(spark, docs, rows, empty):
    texts = ["Released under the MIT License.", "Apache License, Version 2.0", "CC BY-NC 4.0 and CC BY NC", "This work is licensed under the GNU General Public License, version 3.", "this work is GNU licensed under public general the license", None, ""]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [out[i].base_labels for i in range(7)] == ["mit", "apache-2", "cc-by-nc", "", "", "", ""]
    assert (out[2].n_base, out[2].first_word, out[2].last_word) == (2, 0, 6)
    assert out[3].labels == "gpl-3" and out[3].score >= 0.8 and out[4].labels == "gpl-3" and out[6].n_words == 0
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(empty).count() == 0


def test_licenses_across_lines(spark):
    wrap = lambda label: "\n".join(textwrap.wrap("Some words. " + licenses.TEMPLATES[label], 60))
    labels = sorted(licenses.TEMPLATES)
    apart = " ".join(w + " lorem" * 30 for w in licenses.TEMPLATES["mit"].split())
    texts = [wrap(x) for x in labels] + [apart]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert all(x in out[i].labels.split(",") and out[i].score == 1.0 for i, x in enumerate(labels))
    assert not out[len(labels)].labels and out[len(labels)].score == 0.0


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = bpe.ByteModel(path).library
    out = packing.pack(docs, path).collect()
    expect = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (0,)) for r in rows)
    pieces = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, tuple(ids)))
    for (d, ids), n in expect.items():
        if sum(k[0] == d and len(k[1]) == len(ids) for k in expect) == 1 and n == 1:
            got = sorted(pieces[(d, len(ids))])
            assert tuple(x for p in got for x in p[2]) == ids
    assert sum(r.length for r in out) == sum(len(i) * n for (_, i), n in expect.items())
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == -(-sum(r.length for r in out) // 1024)
    assert packing.pack(empty, path).count() == 0


def test_assign_balances():
    rng = random.Random(4)
    lengths = [rng.randint(1, 1023) for _ in range(300)]
    pieces = packing.assign(lengths, 1024)
    assert len({p[3] for p in pieces}) == -(-sum(lengths) // 1024)
    done = Counter()
    for doc, _, n, _, _ in pieces:
        done[doc] += n
    assert done == Counter(dict(enumerate(lengths)))
