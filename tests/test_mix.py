import random
from collections import Counter

from redpen.operators import mix


def test_damage_is_undone_by_its_edits():
    tokens = "a b c d e".split()
    chosen = [(0, 1, "", "M:X", "r"), (2, 3, "x y", "R:X", "r"), (4, 4, "z", "U:X", "r")]
    damaged, edits = mix.damage(tokens, chosen)
    assert damaged == "b x y d z e".split()
    for start, end, text, *_ in reversed(edits):
        damaged[start:end] = text.split()
    assert damaged == tokens


def test_scarce_types_catch_up():
    """Of two types at equal shares the one behind is drawn more often."""
    emitted, picks = Counter({"R:SPELL": 900, "R:WO": 100}), Counter()
    options = [(0, 1, "x", "R:SPELL", "a"), (1, 2, "y", "R:WO", "b")]
    for i in range(300):
        picks[mix.draw(options, 1, random.Random(i), {"R:SPELL": 0.5, "R:WO": 0.5}, emitted)[0][3]] += 1
    assert picks["R:WO"] > 5 * picks["R:SPELL"]


def test_no_overlaps():
    options = [(i, i + 2, "x", f"R:{i}", "r") for i in range(8)] + [(3, 3, ",", "U:A", "r"), (3, 3, ";", "U:B", "r")]
    for i in range(50):
        got = mix.draw(options, 5, random.Random(i), {}, Counter())
        assert len(got) >= 2 and all((a[1] <= b[0] or b[1] <= a[0]) and a[:2] != b[:2] for k, a in enumerate(got) for b in got[:k])


def test_generate_reaches_the_mix(spark):
    rows = [(i, ["a", "b", "c"], [{"start": 0, "end": 1, "correction": "x", "error_type": "A", "rule": "r"}] + ([{"start": 1, "end": 2, "correction": "", "error_type": "B", "rule": "s"}] if i % 2 else [])) for i in range(400)]
    df = spark.createDataFrame(rows, f"sid long, tokens array<string>, candidates {mix.EDITS}")
    out = mix.generate(df, {"A": 0.7, "B": 0.3}, seed=1, clean_share=0.2, most=1, shards=2).collect()
    kinds = Counter(e.error_type for r in out for e in r.edits)
    assert len(out) == 400 and 0.2 < kinds["B"] / kinds.total() < 0.4
    assert 0.1 < sum(r.outcome == "negative" for r in out) / 400 < 0.3
