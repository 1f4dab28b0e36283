import pytest
from pyspark.sql import functions as F

from redpen.functions import edits
from redpen.sources import corpora

M2 = """S Der alte Turm steht schon an Fluss .
A 4 5|||U:ADV||||||REQUIRED|||-NONE-|||0
A 5 6|||R:ADP|||am|||REQUIRED|||-NONE-|||0

S Wir trinkt Wasser .
A 1 2|||R:VERB:FORM|||trinken|||REQUIRED|||-NONE-|||0
A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||1
S Sie liest Buch .
A 2 2|||M:DET|||das|||REQUIRED|||-NONE-|||0
"""


@pytest.fixture
def m2(spark, tmp_path):
    (tmp_path / "a.m2").write_text(M2)
    return corpora.read_m2(spark, str(tmp_path / "a.m2"))


def test_read_and_apply(m2):
    own = edits.edits_for(F.col("edits"))
    out = m2.select("sid", F.array_join(edits.apply(F.col("tokens"), own), " ").alias("t"), edits.annotators(F.col("edits")).alias("a")).orderBy("sid").collect()
    assert [r.t for r in out] == ["Der alte Turm steht am Fluss .", "Wir trinken Wasser .", "Sie liest das Buch ."]
    assert [r.a for r in out] == [[0], [0, 1], [0]]


def test_round_trip(m2, spark, tmp_path):
    corpora.write_m2(m2, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.strip() == M2.replace("|||1\nS", "|||1\n\nS").strip()


def test_malformed_edit_raises(spark, tmp_path):
    (tmp_path / "bad.m2").write_text("S a b\nA 0 1|||R\n")
    with pytest.raises(Exception, match="bad.m2"):
        corpora.read_m2(spark, str(tmp_path / "bad.m2")).collect()


def test_overlaps(spark):
    make = lambda *e: F.array(*[F.struct(F.lit(s).alias("start"), F.lit(t).alias("end"), F.lit("X").alias("error_type"), F.lit("z").alias("correction"), F.lit(0).alias("annotator")) for s, t in e])
    row = spark.range(1).select(edits.overlapping(make((0, 2), (1, 3))).alias("a"), edits.overlapping(make((0, 2), (2, 2), (2, 3))).alias("b"), edits.apply(F.lit(["a", "b", "c"]), make((0, 2), (1, 3)), strict=False).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, ["z", "c"])


def test_spans_and_windows(spark):
    row = spark.range(1).select(edits.token_spans(F.lit(["a", "😀é", "c"])).alias("s"), edits.occurrences(F.lit(["a", "b", "a", "b"]), F.lit(["a", "b"])).alias("n"), edits.occurrences(F.lit(["a"]), F.lit(["a", "b"])).alias("z")).first()
    assert [tuple(x) for x in row.s] == [(0, 1), (2, 4), (5, 6)] and (row.n, row.z) == (2, 0)


def test_scores_of_nothing(spark):
    row = spark.range(1).select(edits.f_score(F.lit(0), F.lit(0), F.lit(0)).alias("a"), edits.f_score(F.lit(3), F.lit(1), F.lit(1)).alias("b")).first()
    assert row.a == 0.0 and abs(row.b - 0.75) < 1e-12
