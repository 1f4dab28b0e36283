"""Errors drawn towards a target mix of types, with the counts so far as feedback."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (start, end, correction, error_type, rule) over the correct tokens.
Candidate = tuple[int, int, str, str, str]

EDITS = "array<struct<start:int,end:int,correction:string,error_type:string,rule:string>>"


# What a type above its share keeps of its weight, and the least weight.
STARVED, LEAST = 0.05, 1e-6


def weights(kinds: Sequence[str], targets: dict[str, float], emitted: Counter) -> np.ndarray:
    """The weight of each type: what it lacks to its share of all errors so far."""
    target = np.array([targets.get(k, 0.0) for k in kinds])
    share = np.array([emitted[k] for k in kinds]) / max(emitted.total(), 1)
    return np.maximum.reduce([target - share, STARVED * target, np.full(len(target), LEAST)])


def draw(candidates: Sequence[Candidate], count: int, rng: random.Random, targets: dict[str, float], emitted: Counter) -> list[Candidate]:
    """Up to ``count`` candidates that go together, in the order of start.

    Every type rings at the times of a Poisson process whose rate is its weight, and each
    ring takes one of its candidates at random that still goes with those taken. So types
    are drawn by their weights, whatever the number of their candidates, in one pass."""
    shuffled = sorted(candidates, key=lambda _: rng.random())
    kinds = sorted({c[3] for c in candidates})
    rings = []
    for kind, rate in zip(kinds, weights(kinds, targets, emitted).tolist(), strict=True):
        rings += [(t, kind) for t in accumulate(rng.expovariate(rate) for _ in range(count))]
    taken = np.zeros((0, 2))
    chosen: list[Candidate] = []
    for _, kind in sorted(rings):
        if len(chosen) == count:
            break
        for c in (c for c in shuffled if c[3] == kind):
            apart = (taken[:, 1] <= c[0]) | (c[1] <= taken[:, 0])
            same_gap = (taken == c[0]).all(1) & (c[0] == c[1])
            if (apart & ~same_gap).all():
                taken = np.vstack([taken, c[:2]])
                chosen.append(c)
                break
    return sorted(chosen)


def damage(tokens: Sequence[str], chosen: Sequence[Candidate]) -> tuple[list[str], list[Candidate]]:
    """The damaged tokens, and the edits that undo the damage, over the damaged tokens."""
    out, edits, at = [], [], 0
    for start, end, text, kind, rule in chosen:
        out += tokens[at:start]
        begin = len(out)
        out += text.split()
        edits.append((begin, len(out), " ".join(tokens[start:end]), kind, rule))
        at = end
    return [*out, *tokens[at:]], edits


def generate(rows: DataFrame, targets: dict[str, float], seed: int, clean_share: float = 0.1, most: int = 3, shards: int = 64) -> DataFrame:
    """Damaged sentences (sid, tokens, edits, outcome) of correct ones (sid, tokens,
    candidates). A share stays correct (``negative``), as does what no rule touches
    (``barren``); the others take one to ``most`` errors.

    The mix is steered by what a shard has emitted, in the order of sid, and every shard
    reaches the targets for itself, so the union does. The number of shards decides which
    rows come out, not the mix; choose it so that a shard fits a task."""

    def one(_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        emitted: Counter = Counter()
        out = []
        for row in part.sort_values("sid").itertuples(index=False):
            rng = random.Random(f"{seed}:{row.sid}")
            options = [tuple(c[f] for f in ("start", "end", "correction", "error_type", "rule")) for c in row.candidates]
            tokens = list(row.tokens)
            if rng.random() < clean_share:
                out.append((row.sid, tokens, [], "negative"))
                continue
            chosen = draw(options, rng.randint(1, most), rng, targets, emitted)
            emitted.update(c[3] for c in chosen)
            damaged, edits = damage(tokens, chosen)
            out.append((row.sid, damaged, edits, "damaged" if chosen else "barren"))
        frame = pd.DataFrame(out, columns=["sid", "tokens", "edits", "outcome"])
        frame["edits"] = [[dict(zip(("start", "end", "correction", "error_type", "rule"), e, strict=True)) for e in x] for x in frame["edits"]]
        return frame

    kind = rows.schema["sid"].dataType.simpleString()
    dealt = rows.select("sid", "tokens", "candidates", F.pmod(F.xxhash64("sid"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(one, f"sid {kind}, tokens array<string>, edits {EDITS}, outcome string")


def noop(rows: DataFrame) -> DataFrame:
    """Correct sentences (sid, tokens) as damaged ones without any edit."""
    return rows.select("sid", "tokens", F.array().cast(EDITS).alias("edits"), F.lit("negative").alias("outcome"))


def outcomes(generated: DataFrame) -> DataFrame:
    """Totals of generated sentences: total, negative (barren ones too), damaged, barren,
    and the share of negatives, 0 of none."""
    count = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    out = generated.agg(F.count("*").alias("total"), count("negative", "barren").alias("negative"), count("damaged").alias("damaged"), count("barren").alias("barren"))
    return out.withColumn("negative_share", F.coalesce(F.try_divide("negative", "total"), F.lit(0.0)))
