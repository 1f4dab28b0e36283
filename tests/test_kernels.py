import random

import pytest

from redpen.operators import kernels


def test_token_distance():
    assert [kernels.token_distance(list(a), list(b)) for a, b in (("abc", "abc"), ("abc", "axc"), ("abc", "ac"), ("", "ab"))] == [0, 1, 1, 2]


def test_token_distance_random():
    rng = random.Random(1)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert kernels.token_distance(a, b) == slow(a, b)


@pytest.mark.parametrize(
    ("source", "hyp", "gold", "counts"),
    [
        ("Ich sehe der Frau .", "Ich sehe die Frau .", [(2, 3, "die")], (1, 0, 0)),
        ("Ich sehe der Frau .", "Ich sehe die Frau .", [(2, 4, "die Frau")], (1, 0, 0)),
        ("Alles richtig hier .", "Alles richtig hier .", [(-1, -1, "-NONE-")], (0, 0, 0)),
        ("Ich habe sehr viel gearbeitet .", "Ich habe viel gearbeitet heute .", [(2, 3, ""), (5, 5, "heute")], (2, 0, 0)),
        ("a b", "a c", [(0, 1, "x"), (0, 1, "x")], (0, 1, 1)),
    ],
)
def test_maxmatch_counts(source, hyp, gold, counts):
    assert kernels.maxmatch_counts(source.split(), hyp.split(), gold) == counts


def test_maxmatch_descriptions():
    source, hyp = "Ich habe sehr viel gearbeitet .".split(), "Ich habe viel gearbeitet heute .".split()
    assert kernels.maxmatch_edits(source, hyp, set()) == [(2, 5, "viel gearbeitet heute")]
    assert len(kernels.maxmatch_edits("a b c d e f g h".split(), "x b c d e f g y".split(), set())) == 2


def test_annotator_fold():
    assert kernels.annotator_fold([[(0, 1, 1), (1, 0, 0)], [(1, 0, 0), (0, 0, 1)]]) == (2, 0, 0)


def test_churn():
    assert kernels.churn(["a", "b"], ["a", "b"]) == 0.0 and kernels.churn(["a"], ["b"]) == 1.0 and kernels.churn([], []) == 0.0
