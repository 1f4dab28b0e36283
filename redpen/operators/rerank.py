"""Reranking of candidate lists, and preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import differing, token_distance


def pick(beam: DataFrame, score: Column, sid: str = "sid", rank: str = "rank") -> DataFrame:
    """The candidate of the highest score of each list; the lowest rank of equal ones."""
    best = beam.groupBy(sid).agg(F.min(F.struct((-score).alias("loss"), F.col(rank).alias("r"))).alias("m"))
    return best.select(sid, F.col("m.r").alias("picked"), (-F.col("m.loss")).alias("value"))


def min_edit(beam: DataFrame, weight: float) -> DataFrame:
    """The model's score less ``weight`` for each token that a candidate changes."""
    return pick(beam, F.round(F.col("score") - weight * F.col("distance"), 6))


def oracle(beam: DataFrame) -> DataFrame:
    """The most hits less false ones, then the least distance, then the lowest rank."""
    best = beam.groupBy("sid").agg(F.min(F.struct((F.col("fp") - F.col("tp")).alias("a"), F.col("distance").alias("d"), F.col("rank").alias("r"))).alias("m"))
    return best.select("sid", F.col("m.r").alias("picked"), (-F.col("m.a")).alias("gain"))


def minimum_risk(beam: DataFrame) -> DataFrame:
    """The candidate nearest to its siblings: lists hold a few candidates, which are brought
    together once. ``edits`` is the set of a candidate's edits; two are apart by what only
    one of them has. Edits are compared as JSON, as only sets of texts are hashed."""
    keys = F.array_distinct(F.transform("edits", lambda e: F.to_json(F.struct(e.alias("e")))))
    lists = beam.where("sid is not null").select("sid", F.struct("rank", keys.alias("keys")).alias("c")).groupBy("sid").agg(F.collect_list("c").alias("all"))
    apart = lambda x, y: F.size(x["keys"]) + F.size(y["keys"]) - 2 * F.size(F.array_intersect(x["keys"], y["keys"]))
    risks = F.transform("all", lambda x: F.struct(x["rank"].alias("rank"), F.aggregate("all", F.lit(0).cast("bigint"), lambda n, y: n + apart(x, y)).alias("risk")))
    risk = lists.select("sid", F.explode(risks).alias("r")).select("sid", "r.*")
    return pick(risk, -F.col("risk")).withColumn("value", -F.col("value"))


def preference_pairs(beam: DataFrame, least_gain: int = 1) -> DataFrame:
    """(sid, chosen_rank, gain): lists whose best candidate by the oracle isn't the first,
    is strictly better and reads differently."""
    first = beam.where("rank = 0").select("sid", (F.col("tp") - F.col("fp")).alias("base"), F.col("text").alias("rejected"))
    best = oracle(beam).where("picked > 0").join(beam.select("sid", F.col("rank").alias("picked"), F.col("text").alias("chosen")), ["sid", "picked"])
    out = best.join(first, "sid").withColumn("gain", F.col("gain") - F.col("base"))
    return out.where((F.col("gain") >= least_gain) & (F.col("chosen") != F.col("rejected"))).select("sid", F.col("picked").alias("chosen_rank"), "gain")


def at_random(beam: DataFrame, seed: str) -> DataFrame:
    """A candidate of each list by the SHA-256 of seed, list and rank: a control."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.col("sid").cast("string"), F.col("rank").cast("string")), 256)
    return beam.groupBy("sid").agg(F.min_by("rank", key).alias("picked"))


def _over_lists(beam: DataFrame, columns: list[str], more: str, add: Callable[[list[dict]], None]) -> DataFrame:
    """``columns`` of the beam with the columns ``more``, which ``add`` puts into the rows of
    one list, given with all that the beam has. Lists are dealt out once and read one by
    one, so a task holds a batch and a list."""
    made = T.StructType.fromDDL(more)
    out = T.StructType([*[beam.schema[c] for c in columns], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(made)

        def whole(part: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = part.select(read).to_pylist()
            for _, own in groupby(rows, key=lambda r: r["sid"]):
                add(list(own))
            part = part.select(columns)
            for field in kinds:
                part = part.append_column(field, pa.array([r[field.name] for r in rows], field.type))
            yield from part.combine_chunks().to_batches()

        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            sids, end = held["sid"].to_pylist(), held.num_rows
            while end and sids[end - 1] == sids[-1]:
                end -= 1
            if end:
                yield from whole(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield from whole(held)

    read = [c for c in ("sid", "text", "source", "score") if c in beam.columns]
    return beam.where("sid is not null").repartition("sid").sortWithinPartitions("sid").mapInArrow(run, out)


def _risks(rows: list[dict]) -> None:
    """Adds ``risk`` and ``identical`` to the rows of one list: a pair is compared once."""
    words = [None if r["text"] is None else r["text"].split() for r in rows]
    for r in rows:
        r["risk"], r["identical"] = (None, -1) if r["text"] is None else (0, 0)
    for (x, a), (y, b) in combinations(zip(rows, words, strict=True), 2):
        if a is None or b is None:
            continue
        if x["text"] == y["text"]:
            x["identical"] += 1
            y["identical"] += 1
        else:
            apart = token_distance(a, b)
            x["risk"] += apart
            y["risk"] += apart


def distances(beam: DataFrame) -> DataFrame:
    """``beam`` (sid, rank, text) with ``risk``, the sum of token distances to the list's
    other candidates, and ``identical``, how many of them read alike. Lists hold a few
    candidates, which are read together."""
    return _over_lists(beam, beam.columns, "risk bigint, identical bigint", _risks)


def least_risk(beam: DataFrame) -> DataFrame:
    """The candidate whose token distances to its siblings sum up to the least."""
    return pick(distances(beam), -F.col("risk")).withColumn("value", -F.col("value"))


FEATURES = ("score", "margin", "rank", "edits", "edit_share", "longer", "operations", "mean_risk", "identical")


def _featured(rows: list[dict]) -> None:
    """Adds what features are made of to the rows of one list."""
    _risks(rows)
    scores = [r["score"] for r in rows if r["score"] is not None]
    best = next((x for x in scores if x != x), max(scores, default=None))
    for r in rows:
        a, b = (None if r[c] is None else r[c].split() for c in ("source", "text"))
        r["best"], r["others"] = best, len(rows) - 1
        r["before"], r["after"] = (None if x is None else len(x) for x in (a, b))
        r["edits"], r["operations"] = (None, None) if a is None or b is None else (token_distance(a, b), differing(a, b))


def features(beam: DataFrame) -> DataFrame:
    """FEATURES of every candidate; no gold is looked at. ``beam`` has sid, rank, score, text
    and ``source``."""
    beam = beam.withColumn("score", F.col("score").cast("double"))
    more = "risk bigint, identical bigint, best double, others int, before int, after int, edits int, operations int"
    rows = _over_lists(beam, ["sid", "rank", "score"], more, _featured)
    columns = (
        F.col("score"), F.col("score") - F.col("best"), F.col("rank").cast("double"), F.col("edits").cast("double"), F.col("edits") / F.greatest(F.col("before"), F.lit(1)),
        (F.col("after") - F.col("before")).cast("double"), F.col("operations").cast("double"), F.col("risk") / F.greatest(F.col("others"), F.lit(1)), F.col("identical").cast("double"),
    )
    return rows.select("sid", F.col("rank").alias("candidate"), *[c.alias(n) for c, n in zip(columns, FEATURES, strict=True)])


def labelled(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Features with a ``label``: 1 for the candidate that the oracle picks, else 0."""
    return rows.join(best.select("sid", F.col("picked").alias("_p")), "sid").withColumn("label", F.when(F.col("candidate") == F.col("_p"), 1.0).otherwise(0.0)).drop("_p")


def fit(rows: DataFrame, epochs: int, rate: float = 0.5, write: Callable[[DataFrame], DataFrame] = lambda d: d) -> np.ndarray:
    """Weights (one a feature, then the constant) of a logistic regression by full-batch
    descent from zero: every epoch is one sum over all rows. ``write`` cuts the lineage of
    the rows, which are read once an epoch."""
    rows = write(rows)
    weights = np.zeros(len(FEATURES) + 1)
    inputs = [F.col(f) for f in FEATURES] + [F.lit(1.0)]
    for _ in range(epochs):
        score = sum((x * float(w) for x, w in zip(inputs[1:], weights[1:], strict=True)), inputs[0] * float(weights[0]))
        error = 1 / (1 + F.exp(-score)) - F.col("label")
        step = rows.agg(*[F.coalesce(F.avg(x * error), F.lit(0.0)) for x in inputs]).first()
        weights -= rate * np.array(step)
    return weights


def by_weights(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """The candidate of the highest score by learned weights; the first of equal ones."""
    score = sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights[:-1], strict=True)), F.lit(float(weights[-1])))
    return pick(rows, score, rank="candidate")


def gains(pairs: DataFrame) -> DataFrame:
    """How many preference pairs there are of each chosen rank and gain."""
    return pairs.groupBy("chosen_rank", "gain").agg(F.count("*").alias("n"))
