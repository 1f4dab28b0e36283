"""The pipeline's stages on rows with every hard case, and what they do to planted ones."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from redpen.llm import common, quality, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["".join(rng.choice("bdfklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    texts = [text(rng.randint(80, 160)) for _ in range(60)]
    passage = text(60)
    shared = [f"{text(70)} {passage} {text(70)}" for _ in range(3)]
    near = texts[0].replace(" ", "  ", 1)
    changed = " ".join(w if k != 40 else "changed" for k, w in enumerate(texts[1].split()))
    junk = ["$$$ &&& " * 60, "no " * 90, "", None]
    everything = [*texts, *shared, near, changed, texts[2], *junk]
    return [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, len(t or "")) for i, t in enumerate(everything)], passage


def test_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows[0], SCHEMA).repartition(3)
    good = corpus_pipeline.quality_rules(spark, docs, "")
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert not kept & {66, 67, 68, 69} and len(kept & set(range(66))) >= 62
    single = corpus_pipeline.near_duplicates(spark, docs, "")
    left = {r.doc_id for r in single.collect()}
    assert single.columns == docs.columns and {0, 1, 2} <= left and not left & {63, 64, 65} and set(range(3, 63)) <= left
    cut = corpus_pipeline.repeated_passages(spark, single, "")
    assert cut.columns == docs.columns and cut.count() == len(left)
    texts = {r.doc_id: r for r in cut.collect()}
    assert all(rows[1] not in texts[i].text and texts[i].n_chars == len(texts[i].text) for i in (60, 61, 62))
    assert texts[5].text == rows[0][5][1]
    pieces = corpus_pipeline.packed(spark, cut, "").collect()
    assert {r.doc_id for r in pieces} == left and all(zlib.crc32(r.ids) == r.ids_crc32 and len(np.frombuffer(r.ids, "<u4")) == r.length for r in pieces)


def test_quality_rules_copy_no_text(spark, rows):
    """The stage judges rows where they are: same verdicts as by id, columns of any kind and
    name, and nothing with a text is written or joined."""
    docs = spark.createDataFrame(rows[0], SCHEMA).repartition(3)
    wide = docs.selectExpr("*", "array(doc_id) AS `a b`", "map('k', n_chars) AS m", "timestamp_seconds(doc_id) AS row", "named_struct('x y', text) AS rid")
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    good = corpus_pipeline.quality_rules(spark, wide, "")
    assert good.columns == wide.columns and good.dtypes == wide.dtypes
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert sorted(map(repr, good.collect())) == sorted(map(repr, wide.where(F.col("doc_id").isin(kept)).collect()))
    made = [p for p in set(folder.iterdir()) - before if p.name.split("-")[0] != "stats"]
    assert not any("text" in spark.read.parquet(str(p)).schema.simpleString() for p in made)
    assert "SortMergeJoin" not in good._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [simhash.BROADCAST_WORDS, 0])
def test_near_duplicates_move_no_text(spark, rows, monkeypatch, most):
    """Rows are written once and picked where they are; what else is written holds no text
    and goes when the result is known. Without room for a broadcast, joins give the same."""
    monkeypatch.setattr(simhash, "BROADCAST_WORDS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([*rows[0], rows[0][5], (None, *rows[0][5][1:]), (None, *rows[0][7][1:])], SCHEMA).repartition(3)
        folder = Path(common.shared_dir(spark).removeprefix("file:"))
        before = set(folder.iterdir())
        out = simhash.representatives(docs)
        made = {p for p in set(folder.iterdir()) - before}
        assert [p.name.split("-")[0] for p in made if "text" in spark.read.parquet(str(p)).schema.simpleString()] == ["rows"]
        assert not {"prints", "near", "classes", "first"} & {p.name.split("-")[0] for p in made}
        assert ("SortMergeJoin" in out._jdf.queryExecution().toString()) == (most == 0)
        got = sorted((-1 if r.doc_id is None else r.doc_id for r in out.collect()))
        # all but the near (63), changed (64) and repeated (65) ones, the row that stands twice and those without an id
        assert got == [*range(63), 66, 67, 68, 69]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        docs = out if name != "packing" else docs
