from pyspark.sql import functions as F

from redpen.operators import encoding


def test_encode_masks_and_weighs():
    got = encoding.encode([1, 2], [3, 4, 5], [(0, 2), (2, 6), (6, 9)], 99, 5, 0.25, 10)
    assert got == ([1, 2, 3, 4, 5, 99], [-100, -100, 3, 4, 5, 99], [0.0, 0.0, 1.0, 0.25, 0.25, 1.0])
    assert encoding.encode([1, 2], [3], [(0, 1)], 99, None, 0.25, 3) is None


def test_collate(spark):
    rows = spark.createDataFrame([(1, "a", [1, 2, 3], [1, 2, 3], [1.0, 1.0, 1.0]), (2, "a", [4], [4], [1.0]), (3, "b", [5], [5], [1.0])], "sid int, batch string, ids array<int>, labels array<int>, weights array<double>")
    got = {r.sid: (r.ids, r.labels, r.weights) for r in encoding.collate(rows, "batch", 0).collect()}
    assert got[2] == ([4, 0, 0], [4, -100, -100], [1.0, 0.0, 0.0]) and got[3] == ([5], [5], [1.0])


def test_iterate(spark):
    rows = spark.createDataFrame([(1, "aaa"), (2, "b")], "sid int, text string")
    shorter = lambda d: d.withColumn("text", F.regexp_replace("text", "^aa", "a"))
    got = encoding.iterate(rows, shorter, 3, lambda d: d)
    assert {r.sid: (r.text, r.rounds) for r in got.collect()} == {1: ("a", 2), 2: ("b", 0)}
