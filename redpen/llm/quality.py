"""Quality rules: fixed floors, then robust outliers of text statistics per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import drop_written, map_texts, written

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MARKS = b"!?\"'()-/:;=@[\\]^_`{}~+"
#: Letters of a word and words of a line, about, for the sampling errors below.
WORD_CHARS, LINE_WORDS = 6, 10
#: Share of a group that the estimate rests on.
CORE = 0.75
STEPS = 4
#: What the covariance of the CORE share of least distance is multiplied by to be that
#: of all, for six normal dimensions: CORE / P(chi2(8) <= the CORE quantile of chi2(6)).
CONSISTENCY = 1.3616
#: Deterministic starts of the concentration steps.
STARTS = ("medians", "signs", "ranks")
#: Groups up to which the table of estimates (350 bytes a group and start) is broadcast;
#: beyond it, it is joined, each group dealt over SALTS tasks.
BROADCAST_GROUPS, SALTS = 50_000, 64
#: Rows that the parent's estimate counts as beside a group's own: that of all rows
#: beside a language's, that beside a source's.
PRIOR_ROWS = 12
#: Squared distance beyond which a text is rejected: the chi-square quantile of six
#: dimensions at 0.999.
CUTOFF = 22.46
#: Median of that chi-square distribution.
MEDIAN = 5.348

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts of one text in the order of COUNTS. Words lie apart by ASCII white
    space; lines count if they have a word."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    lines = [x for x in text.split(b"\n") if x.strip()]
    less = lambda drop: len(joined) - len(joined.translate(None, drop))
    return n, chars, less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), less(UPPER), less(MARKS)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, n)
    wide = len(ids)
    pair = code[:-1] * wide + code[1:]
    if wide > 2_000_000:  # three codes don't fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * wide + code[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int(np.count_nonzero(np.r_[twice, False, False] | np.r_[False, twice, False] | np.r_[False, False, twice]))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns in ``also`` and COUNTS of every text; null text has no words."""

    def per_slice(batch: pa.RecordBatch, texts: pa.Array) -> dict:
        rows = np.array([text_counts(t.encode()) for t in texts.to_numpy(zero_copy_only=False)], np.int64).reshape(-1, len(COUNTS))
        return {id_col: batch.column(0)} | {c: batch.column(2 + k) for k, c in enumerate(also)} | {c: rows[:, k] for k, c in enumerate(COUNTS)}

    kinds = StructType([*[StructField(c, docs.schema[c].dataType) for c in (id_col, *also)], *[StructField(c, LongType()) for c in COUNTS]])
    return map_texts(docs, per_slice, kinds, id_col, text_col, also)


def tolerance(least_words: int) -> np.ndarray:
    """The deviation that every dimension has at least: the sampling error of the shortest
    text that passes the floors. An angle of a share of m has an error of 1 / (2 sqrt(m));
    a mean word length, whose deviation is about half of it, 1 / (2 sqrt(words))."""
    chars, lines = WORD_CHARS * least_words, max(1.0, least_words / LINE_WORDS)
    return 0.5 / np.sqrt(np.array([least_words, chars, chars, least_words, lines, chars]))


def _vector() -> list[Column]:
    """The transformed statistics: log mean word length and angles of shares, which
    spread shares near zero evenly."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_upper", "word_chars"),
        share("n_repeat_words", "n_words"),
        share("n_dup_lines", "n_lines"),
        share("n_marks", "word_chars"),
    ]


P = 6
_Z = [f"z{i}" for i in range(P)]


def _distance() -> Column:
    """Squared Mahalanobis distance of z0.. to the group's centre under its inverse."""
    d = [F.col(z) - F.col("centre")[i] for i, z in enumerate(_Z)]
    terms = [d[i] * d[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    return sum(terms[1:], terms[0])


def _with_groups(rows: DataFrame, table: DataFrame, n_groups: int, on: str = "g") -> DataFrame:
    """``rows`` (with a salt) beside the row of ``table`` of their group. The table of few
    groups is broadcast, so rows stay where they are; one of many is copied SALTS times
    and joined by group and salt, so no task gets more than a share of any group."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(table), on)
    return rows.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [on, "salt"])


def _moments(values: list[Column]) -> list[Column]:
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(values)]
    return [F.count("*").alias("n"), *sums, *[F.sum(values[i] * values[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]]


def _covariance(r) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a row of moments."""
    m = np.array([getattr(r, f"s{i}") for i in range(P)]) / r.n
    c = np.empty((P, P))
    for i in range(P):
        for j in range(i, P):
            c[i, j] = c[j, i] = getattr(r, f"s{i}_{j}") / r.n - m[i] * m[j]
    return m, c


_ESTIMATE = "g string, start string, centre array<double>, inverse array<double>, log_det double, n bigint"


def _starts(rows: DataFrame, n_groups: int, floor: np.ndarray) -> DataFrame:
    """A centre and an inverse covariance of each start for every group: the floored
    deviations from the medians without any correlation (medians); the shape of the
    vectors' directions from there, which no length can draw (signs); that of their
    squashed coordinates (ranks)."""
    middle = rows.groupBy("g").agg(*[F.percentile_approx(c, 0.5, 10000).alias(f"m{i}") for i, c in enumerate(_Z)])
    middle = written(middle, "medians")
    apart = _with_groups(rows, middle, n_groups).select("g", *[F.abs(F.col(z) - F.col(f"m{i}")).alias(z) for i, z in enumerate(_Z)])
    spread = apart.groupBy("g").agg(*[F.greatest(F.lit(float(floor[i])), 1.4826 * F.percentile_approx(c, 0.5, 10000)).alias(f"d{i}") for i, c in enumerate(_Z)])
    scales = written(middle.join(spread, "g"), "scales")
    unit = [(F.col(z) - F.col(f"m{i}")) / F.col(f"d{i}") for i, z in enumerate(_Z)]
    scaled = _with_groups(rows, scales, n_groups).select("g", *[u.alias(z) for z, u in zip(_Z, unit, strict=True)])
    norm = F.greatest(F.lit(1e-9), F.sqrt(sum((F.col(z) * F.col(z) for z in _Z[1:]), F.col(_Z[0]) * F.col(_Z[0]))))
    shapes = None
    for name, value in (("signs", lambda z: F.col(z) / norm), ("ranks", lambda z: F.tanh(F.col(z)))):
        part = scaled.select("g", *[value(z).alias(z) for z in _Z]).groupBy("g").agg(*_moments([F.col(z) for z in _Z])).withColumn("start", F.lit(name))
        shapes = part if shapes is None else shapes.unionByName(part)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in parts:
            out = []
            for r in held.itertuples(index=False):
                m, d = (np.array([getattr(r, f"{x}{i}") for i in range(P)]) for x in "md")
                _, c = _covariance(r)
                own = np.sqrt(np.diag(c) + 1e-6)
                inverse = np.linalg.inv((c / np.outer(own, own) + 0.01 * np.eye(P)) * np.outer(d, d))
                out.append((r.g, r.start, m.tolist(), inverse.ravel().tolist(), 0.0, r.n))
                if r.start == "signs":
                    out.append((r.g, "medians", m.tolist(), np.diag(d**-2.0).ravel().tolist(), 0.0, r.n))
            yield pd.DataFrame(out, columns=["g", "start", "centre", "inverse", "log_det", "n"])

    return written(shapes.join(scales, "g").mapInPandas(run, _ESTIMATE), "starts")


def _estimates(moments: DataFrame, floor: np.ndarray) -> DataFrame:
    """Centres and inverse covariances from the moments of a core; the floor on each
    variance keeps degenerate dimensions invertible."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for r in rows.itertuples(index=False):
                m, c = _covariance(r)
                c = CONSISTENCY * c + np.diag(floor**2)
                out.append((r.g, r.start, m.tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1]), r.n))
            yield pd.DataFrame(out, columns=["g", "start", "centre", "inverse", "log_det", "n"])

    return moments.mapInPandas(run, _ESTIMATE)


def robust_estimates(rows: DataFrame, floor: np.ndarray) -> DataFrame:
    """Minimum-covariance-determinant estimates by group ``g`` of vectors z0.. (beside a
    ``salt``): from each of STARTS, concentration steps keep the CORE share of least
    distance and estimate anew, which doesn't raise the determinant of the core's
    covariance; of the starts' ends the one of least determinant is taken (the floored
    covariances are compared). Every step is two aggregations with partial sums, the rows
    stay in place; quantiles are sketches of 1e-4 accuracy."""
    n_groups = rows.select("g").distinct().count()
    now = _starts(rows, n_groups, floor)
    for _ in range(STEPS):
        packed = now.groupBy("g").agg(F.collect_list(F.struct("start", "centre", "inverse")).alias("all"))
        scored = _with_groups(rows, packed, n_groups).select("g", *_Z, F.explode("all").alias("one")).select("g", "one.start", "one.centre", "one.inverse", *_Z)
        scored = scored.select("g", "start", *_Z, _distance().alias("d"))
        limits = written(scored.groupBy("g", "start").agg(F.percentile_approx("d", CORE, 10000).alias("limit")), "limits")
        packed = now.join(limits, ["g", "start"]).groupBy("g").agg(F.collect_list(F.struct("start", "centre", "inverse", "limit")).alias("all"))
        core = _with_groups(rows, packed, n_groups).select("g", *_Z, F.explode("all").alias("one")).select("g", "one.start", "one.centre", "one.inverse", "one.limit", *_Z)
        core = core.where(_distance() <= F.col("limit")).groupBy("g", "start").agg(*_moments([F.col(z) for z in _Z]))
        now = written(_estimates(core, floor), "estimates")
    best = now.groupBy("g").agg(F.min_by(F.struct("centre", "inverse", "n"), F.struct("log_det", "start")).alias("b"))
    best = written(best.select("g", "b.centre", "b.inverse", "b.n"), "best")
    scored = _with_groups(rows, best, n_groups).select("g", _distance().alias("d"))
    scale = scored.groupBy("g").agg(F.percentile_approx("d", 0.5, 10000).alias("middle"))
    return written(best.join(scale, "g").withColumn("scale", F.greatest(F.lit(1.0), F.col("middle") / MEDIAN)).drop("middle"), "robust")


def _shrunk(levels: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates by the first of ``levels``: each level's own, drawn towards the next
    one's as if that had PRIOR_ROWS rows, so a group of few rows passes over to its own
    estimate by degrees. Rows (g, centre, inverse, scale)."""
    for k in range(3):
        own = estimates.select(F.col("g").alias(f"g{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("centre", "inverse", "scale", "n")])
        levels = levels.join(own, F.col("levels")[k] == F.col(f"g{k}"), "left").drop(f"g{k}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for r in rows.to_dict("records"):
                centre = None
                for k in (2, 1, 0):
                    if r[f"centre{k}"] is None:
                        continue
                    m, c = np.array(r[f"centre{k}"]), np.linalg.inv(np.array(r[f"inverse{k}"]).reshape(P, P))
                    if centre is None:
                        centre, spread, scale = m, c, r[f"scale{k}"]
                        continue
                    w = r[f"n{k}"] / (r[f"n{k}"] + PRIOR_ROWS)
                    apart = m - centre
                    spread = w * c + (1 - w) * spread + w * (1 - w) * np.outer(apart, apart)
                    centre, scale = centre + w * apart, w * r[f"scale{k}"] + (1 - w) * scale
                if centre is not None:
                    out.append((r["levels"][0], centre.tolist(), np.linalg.inv(spread).ravel().tolist(), scale))
            yield pd.DataFrame(out, columns=["g", "centre", "inverse", "scale"])

    return levels.mapInPandas(run, "g string, centre array<double>, inverse array<double>, scale double")


def _prepared(stats: DataFrame, least_words: int, repeat_percent: int, lang_col: str, source_col: str) -> DataFrame:
    """``stats`` with base_failed, z0.., the levels of groups and a salt."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumns(dict(zip(_Z, _vector(), strict=True)))
    levels = [F.to_json(F.struct(F.lit(2).alias("k"), F.col(lang_col).alias("l"), F.col(source_col).alias("s"))), F.to_json(F.struct(F.lit(1).alias("k"), F.col(lang_col).alias("l"))), F.lit("{}")]
    salt = F.pmod(F.xxhash64(*_Z, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    return stats.withColumn("levels", F.array(*levels)).withColumn("salt", salt)


def _fitted(stats: DataFrame, least_words: int) -> DataFrame:
    """The estimates for each group of prepared ``stats``."""
    sound = written(stats.where(~F.col("base_failed")).select(F.explode("levels").alias("g"), "salt", *_Z), "vectors")
    floor = tolerance(least_words)
    return written(_shrunk(stats.select("levels").distinct(), robust_estimates(sound, floor)), "shrunk")


def _judged(stats: DataFrame, shrunk: DataFrame) -> DataFrame:
    """Prepared ``stats`` with distance and kept."""
    stats = stats.withColumn("g", F.col("levels")[0])
    # without any sound row there is no estimate, and the floors alone decide
    judged = _with_groups(stats, shrunk, shrunk.count()) if shrunk.take(1) else stats.withColumns({"centre": F.lit(None).cast("array<double>"), "inverse": F.lit(None).cast("array<double>"), "scale": F.lit(None).cast("double")})
    judged = judged.withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return judged.withColumn("kept", kept)


def verdicts(docs: DataFrame, least_words: int = 50, repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each input row: the id, COUNTS, base_failed, distance and kept.

    A text fails the floors with fewer than ``least_words`` words, or with more than
    ``repeat_percent`` percent of them in repeated 3-word windows. The others are held
    against the robust estimate of their language and source (nulls form groups of
    their own), from as few rows as there are, drawn towards that of the language and
    this towards that of all rows, the more the fewer rows a group has; without any
    sound row the floors alone decide and distance is null. Null text has no
    words and fails; repeated rows stay; an empty table gives no rows."""
    docs = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col), F.col(source_col))
    stats = written(_prepared(statistics(docs, id_col, text_col, (lang_col, source_col)), least_words, repeat_percent, lang_col, source_col), "stats")
    return _judged(stats, _fitted(stats, least_words)).select(id_col, *COUNTS, "base_failed", "distance", "kept")


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs``, all columns, without those whose verdict isn't kept. The texts are counted
    twice, for the estimates and beside the rows that are judged by them, so that no row is
    copied or dealt by an id."""
    counted = lambda row: _prepared(
        statistics(docs.select(row.alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), "row", "text", ("lang", "source")), 50, 50, "lang", "source"
    )
    stats = written(counted(F.lit(0)), "stats")
    shrunk = _fitted(stats, 50)
    drop_written(stats)
    return _judged(counted(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), shrunk).where("kept").select("row.*")
