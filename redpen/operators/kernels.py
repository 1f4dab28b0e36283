"""Alignment kernels that no built-in function expresses, as Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_distance(a: Sequence[str], b: Sequence[str], substitution: int = 1) -> int:
    """Edit distance over tokens. What both have at their ends is left out, and where one is
    the other with tokens left out, the lengths tell; else a column of the table is held in
    the bits of two numbers (Myers and Hyyrö), or a row in an array if a substitution
    doesn't cost 1."""
    x, y = (list(a), list(b)) if len(a) >= len(b) else (list(b), list(a))
    n, m = len(x), len(y)
    head = 0
    while head < m and x[head] == y[head]:
        head += 1
    while m > head and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    x, y = x[head:n], y[head:m]
    rest = iter(x)
    if all(t in rest for t in y):
        return len(x) - len(y)
    return _by_bits(x, y) if substitution == 1 else _by_rows(x, y, substitution)


def _by_bits(x: list[str], y: list[str]) -> int:
    """Edit distance; bit i of ``up`` and ``down`` tells whether the table rises or falls
    from y's token i - 1 to i in the column of a token of x."""
    places: dict[str, int] = {}
    for i, t in enumerate(y):
        places[t] = places.get(t, 0) | 1 << i
    whole = (1 << len(y)) - 1
    up, down = whole, 0
    for t in x:
        same = places.get(t, 0)
        flat = same | down
        level = (((same & up) + up) ^ up) | same
        right = (down | whole & ~(level | up)) << 1 | 1
        down, up = right & flat & whole, ((up & level) << 1 | ~(flat | right)) & whole
    return len(x) + up.bit_count() - down.bit_count()


def _by_rows(x: list[str], y: list[str], substitution: int) -> int:
    code: dict[str, int] = {}
    a, b = (np.array([code.setdefault(t, len(code)) for t in side], np.int64) for side in (x, y))
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, t in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + np.where(b == t, 0, substitution))
        # insertions run along the row: the least of (value - place) so far, plus the place
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def churn(source: Sequence[str], target: Sequence[str]) -> float:
    """1 - 2 * kept / total tokens, kept by matching blocks."""
    total = len(source) + len(target)
    kept = sum(m.size for m in difflib.SequenceMatcher(None, source, target, autojunk=False).get_matching_blocks())
    return 1 - 2 * kept / total if total else 0.0


def differing(a: Sequence[str], b: Sequence[str]) -> int:
    """How many stretches differ between two token lists by their matching blocks: those of
    ``difflib.SequenceMatcher(None, a, b)``, its popular tokens included. It looks for the
    longest block of each part anew; here the runs of all matches are found once, taken from
    the longest on and cut to the part that they fall in."""
    a, b = list(a), list(b)
    if a == b:
        return 0
    n, m = len(a), len(b)
    places: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        if t in places:
            places[t].append(j)
        else:
            places[t] = [j]
    popular = False
    if m >= 200:
        often = [t for t, js in places.items() if len(js) > m // 100 + 1]
        popular = bool(often)
        for t in often:
            del places[t]
    runs: dict[int, list[tuple[int, int]]] = {}
    open_runs: dict[int, int] = {}
    none: tuple = ()
    for i, t in enumerate(a):
        here: dict[int, int] = {}
        for j in places.get(t, none):
            here[j] = open_runs.pop(j - 1, 0) + 1
        for j, k in open_runs.items():
            if k in runs:
                runs[k].append((i - k, j - k + 1))
            else:
                runs[k] = [(i - k, j - k + 1)]
        open_runs = here
    for j, k in open_runs.items():
        runs.setdefault(k, []).append((n - k, j - k + 1))
    # the blocks taken, by where they begin and end in a and in b, between two empty ones
    ai, ae, bi, be = [0, n], [0, n], [0, m], [0, m]
    for k in range(max(runs, default=0), 0, -1):
        for i, j in sorted(runs.pop(k, none)):
            at = bisect_right(ai, i, 0, len(ai) - 1)
            low, high, left, right = ae[at - 1], ai[at], be[at - 1], bi[at]
            skip = max(low - i, left - j, 0)
            if skip >= k:
                continue
            stop = min(high - i, right - j, k)
            if skip or stop < k:
                # what lies in this part, and what may lie in a later one
                if stop > skip:
                    runs.setdefault(stop - skip, []).append((i + skip, j + skip))
                if k > high - i:
                    rest = high - i
                    runs.setdefault(k - rest, []).append((i + rest, j + rest))
                continue
            x, y = i + k, j + k
            if popular:
                while i > low and j > left and a[i - 1] == b[j - 1]:
                    i, j = i - 1, j - 1
                while x < high and y < right and a[x] == b[y]:
                    x, y = x + 1, y + 1
            ai.insert(at, i)
            ae.insert(at, x)
            bi.insert(at, j)
            be.insert(at, y)
    if popular:
        # a part without a run may still begin alike
        for at in range(1, len(ai)):
            x, y = ae[at - 1], be[at - 1]
            while x < ai[at] and y < bi[at] and a[x] == b[y]:
                x, y = x + 1, y + 1
            ae[at - 1], be[at - 1] = x, y
    return sum(ae[at - 1] < ai[at] or be[at - 1] < bi[at] for at in range(1, len(ai)))


class Lattice:
    """All optimal alignments of two token sequences (a substitution costs 2), as a grid
    of the vertices (i, j) that lie on one."""

    def __init__(self, source: Sequence[str], hyp: Sequence[str]):
        self.source, self.hyp = list(source), list(hyp)
        n, m = len(source), len(hyp)
        code: dict[str, int] = {}
        x, y = (np.array([code.setdefault(t, len(code)) for t in side], np.int64) for side in (source, hyp))
        self.same = x[:, None] == y[None, :]
        ahead = self._table(self.same)
        behind = self._table(self.same[::-1, ::-1])[::-1, ::-1]
        total = ahead[n, m]
        step = np.where(self.same, np.int32(0), np.int32(2))
        self.diagonal = ahead[:-1, :-1] + step + behind[1:, 1:] == total
        self.delete = ahead[:-1, :] + 1 + behind[1:, :] == total
        self.insert = ahead[:, :-1] + 1 + behind[:, 1:] == total

    @staticmethod
    def _table(same: np.ndarray) -> np.ndarray:
        n, m = same.shape
        out = np.zeros((n + 1, m + 1), np.int32)
        steps = np.arange(m + 1, dtype=np.int32)
        out[0] = steps
        for i in range(n):
            row = np.r_[i + 1, np.minimum(out[i, 1:] + 1, out[i, :-1] + np.where(same[i], 0, 2))]
            out[i + 1] = np.minimum.accumulate(row - steps) + steps
        return out

    def unchanged(self, i: int, j: int, span: int, most: int) -> dict[tuple[int, int], int]:
        """The fewest unchanged tokens on the way from (i, j) to each vertex in reach, with
        ``most`` of them at the utmost."""
        n, m = len(self.source), len(self.hyp)
        least = {(i, j): 0}
        ahead = {0: {i}}
        for step in range(2 * span + 1):
            for a in sorted(ahead.pop(step, ())):
                b = i + j + step - a
                here = least[(a, b)]
                ways = []
                if a < n and b < m and self.diagonal[a, b]:
                    ways.append((a + 1, b + 1, here + bool(self.same[a, b])))
                if a < n and self.delete[a, b]:
                    ways.append((a + 1, b, here))
                if b < m and self.insert[a, b]:
                    ways.append((a, b + 1, here))
                for x, y, k in ways:
                    if k <= most and x - i <= span and y - j <= span and k < least.get((x, y), 1 << 30):
                        least[(x, y)] = k
                        ahead.setdefault(x + y - i - j, set()).add(x)
        return least


def maxmatch_edits(source: Sequence[str], hyp: Sequence[str], gold: set[tuple[int, int, str]], max_unchanged: int = 2, span: int = 10) -> list[tuple[int, int, str]]:
    """The system's edits, described so that most gold edits match, and then in the fewest
    other edits. An edit spans at most ``span`` tokens a side and ``max_unchanged`` kept ones."""
    if list(source) == list(hyp):
        return []
    grid = Lattice(source, hyp)
    n, m = len(source), len(hyp)
    best: dict[tuple[int, int], tuple[int, int]] = {(0, 0): (0, 0)}
    back: dict[tuple[int, int], tuple[tuple[int, int], tuple[int, int, str] | None]] = {}
    reached: dict[int, set[int]] = {0: {0}}
    for total in range(n + m):
        for i in sorted(reached.pop(total, ())):
            at = (i, total - i)
            cost = best[at]

            def offer(to: tuple[int, int], price: tuple[int, int], edit: tuple[int, int, str] | None, at: tuple[int, int] = at) -> None:
                if to not in best or price < best[to]:
                    best[to], back[to] = price, (at, edit)
                    reached.setdefault(sum(to), set()).add(to[0])

            j = at[1]
            if i < n and j < m and grid.diagonal[i, j] and grid.same[i, j]:
                offer((i + 1, j + 1), cost, None)
            for x, y in grid.unchanged(i, j, span, max_unchanged):
                if (x, y) == at or source[i:x] == hyp[j:y]:
                    continue
                edit = (i, x, " ".join(hyp[j:y]))
                offer((x, y), (cost[0] - 1, cost[1]) if edit in gold else (cost[0], cost[1] + 1), edit)
    out, at = [], (n, m)
    while at != (0, 0):
        at, edit = back[at]
        if edit is not None:
            out.append(edit)
    return out[::-1]


def _embeddings(source: list[str], hyp: list[str]) -> tuple[list[int], list[int]] | None:
    """For each number of hypothesis tokens the least and the greatest place of the source
    that an optimal alignment passes them at; None if tokens aren't only left out."""
    left, right, at = [0], [len(source)], 0
    try:
        for t in hyp:
            at = source.index(t, at) + 1
            left.append(at)
    except ValueError:
        return None
    back, at = source[::-1], 0
    for t in reversed(hyp):
        at = back.index(t, at) + 1
        right.append(len(source) - at)
    return left, right[::-1]


#: Source tokens up to which the lattice is walked vertex by vertex.
_SHORT = 32


def _choice_counts(source: list[str], hyp: list[str], gold: set[tuple[int, int, str]], left: list[int], right: list[int], most: int = 2, span: int = 10) -> tuple[int, int]:
    """Matched and other edits of ``maxmatch_edits`` where tokens are only left out, a place
    of the source at a time for all numbers of hypothesis tokens. An edit of u kept tokens
    may end at a place if they stand in order within its span; only the last ``span`` places
    are held, so a word that stands thousands of times takes no table."""
    n, m = len(source), len(hyp)
    big, none = 1 << 24, 1 << 50
    code: dict[str, int] = {}
    x, y = (np.array([code.setdefault(t, len(code)) for t in side], np.int64) for side in (source, hyp))
    ending: dict[int, list[tuple[int, str]]] = {}
    for s, e, c in gold:
        if 0 < e - s <= span:
            ending.setdefault(e, []).append((s, c))
    texts: dict[str, list[tuple[int, int]]] = {}
    for u in range(1, most + 1) if ending else ():
        for j in range(u, m + 1):
            texts.setdefault(" ".join(hyp[j - u : j]), []).append((u, j))
    # rows are written twice, so that the last ones always lie in a row: the oldest first
    best, same = np.full((2 * span, m + 1), none), np.zeros((2 * span, m + 1), bool)
    # same[.., j]: whether the source's token is the hypothesis' token j - 1
    best[span - 1, 0] = best[2 * span - 1, 0] = 0
    low = high = 0
    for i in range(1, n + 1):
        at = (i - 1) % span
        same[at, 1:] = same[at + span, 1:] = x[i - 1] == y
        while high < m and left[high + 1] <= i:
            high += 1
        while right[low] < i:
            low += 1
        # newest first: places i - 1, i - 2, ..
        before, equal = best[at : at + span][::-1], same[at + 1 : at + span + 1][::-1]
        row = np.full(m + 1, none)
        row[low : high + 1] = before[:, low : high + 1].min(0) + 1
        inside = None
        for u in range(1, most + 1):
            begin = max(low, u)
            if begin > high:
                break
            here = equal[:, begin - u + 1 : high - u + 2]
            if u > 1:
                # the tokens behind the first of the u are within a span that is shorter by one
                cut = inside.shape[1] - here.shape[1]
                here = np.vstack([np.zeros_like(here[:1]), here[1:] & inside[:-1, cut:]])
            inside = np.logical_or.accumulate(here, axis=0)
            ways = np.where(inside[u:], before[u:, begin - u : high - u + 1], none).min(0) + 1
            np.minimum(row[begin : high + 1], ways, out=row[begin : high + 1])
        begin = max(low, 1)
        kept = np.where(equal[0, begin : high + 1], before[0, begin - 1 : high], none)
        np.minimum(row[begin : high + 1], kept, out=row[begin : high + 1])
        for s, c in ending.get(i, ()):
            past = before[i - s - 1]
            if c == "":
                np.minimum(row[low : high + 1], past[low : high + 1] - big, out=row[low : high + 1])
            for u, j in texts.get(c, ()):
                rest = iter(source[s:i])
                if low <= j <= high and i - s > u and past[j - u] < none // 2 and all(t in rest for t in hyp[j - u : j]):
                    row[j] = min(row[j], past[j - u] - big)
        row[row > none // 2] = none
        at = i % span
        best[(at - 1) % span] = best[(at - 1) % span + span] = row
    total = int(row[m])
    tp = -(total // big)
    return tp, total + big * tp


def _deletion_counts(source: list[str], hyp: list[str], keys: set[tuple[int, int, str]], left: list[int], right: list[int], most: int = 2) -> tuple[int, int]:
    """Matched and other edits of a hypothesis that only leaves tokens out. Between two
    places where an alignment has a choice, tokens stand one to one; over more of these than
    two edits may keep, no edit reaches, so the places are judged by themselves, together
    with what is nearer."""
    free = [j for j, (low, high) in enumerate(zip(left, right, strict=True)) if low < high]
    ordered = sorted(keys) if free else []
    tp = fp = k = 0
    while k < len(free):
        first = last = free[k]
        k += 1
        while k < len(free) and free[k] - last < 2 * most:
            last = free[k]
            k += 1
        begin, end = max(first - most, 0), min(last + most, len(hyp))
        if first == last and right[first] - left[first] == 1:
            # one token left out, in an edit of its own or with neighbours
            p = left[first]
            own = ((p - a, p + 1 + b, " ".join(hyp[first - a : first + b])) for a in range(first - begin + 1) for b in range(min(most - a, end - first) + 1))
            hit = (p, p + 1, "") in keys or any(e in keys for e in own)
            tp, fp = tp + hit, fp + (not hit)
            continue
        low, high = left[begin], right[end]
        near = {(s - low, e - low, c) for s, e, c in ordered[bisect_left(ordered, (low,)) : bisect_left(ordered, (high + 1,))] if e <= high}
        if high - low <= _SHORT:
            found = maxmatch_edits(source[low:high], hyp[begin:end], near, most)
            hits = sum(e in near for e in found)
            others = len(found) - hits
        else:
            hits, others = _choice_counts(source[low:high], hyp[begin:end], near, *([x - low for x in side[begin : end + 1]] for side in (left, right)), most)
        tp, fp = tp + hits, fp + others
    return tp, fp


def maxmatch_counts(source: Sequence[str], hyp: Sequence[str], gold: Sequence[tuple[int, int, str]]) -> tuple[int, int, int]:
    """(tp, fp, fn) of one hypothesis; gold edits count once each, noops not at all."""
    keys = {(s, e, c) for s, e, c in gold if s >= 0}
    source, hyp = list(source), list(hyp)
    if source == hyp:
        return 0, 0, len(keys)
    ways = _embeddings(source, hyp)
    if ways is not None:
        tp, fp = _deletion_counts(source, hyp, keys, *ways)
    else:
        system = maxmatch_edits(source, hyp, keys)
        tp = sum(e in keys for e in system)
        fp = len(system) - tp
    return tp, fp, len(keys) - tp


@F.pandas_udf(T.IntegerType())
def token_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


# else a filter on the distance would be pushed below it, with a second call
token_distance_udf = token_distance_udf.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def churn_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else churn(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Composed texts; of a batch only a slice at a time is held as Python's own."""
    one = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t)
    parts = [pa.array([one(t) for t in text.slice(at, 256).to_pylist()], text.type) for at in range(0, len(text), 256)]
    return pa.concat_arrays(parts) if parts else text


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("tp", "fp", "fn")]))
def maxmatch_udf(source: pd.Series, hyp: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Gold is an array of structs that begin with start, end, correction."""
    rows = [maxmatch_counts(s, h, [(e["start"], e["end"], e["correction"]) for e in g]) for s, h, g in zip(source, hyp, gold, strict=True)]
    return pd.DataFrame(rows, columns=["tp", "fp", "fn"], dtype="int32")


def annotator_fold(counts: Sequence[Sequence[tuple[int, int, int]]], beta: float = 0.5) -> tuple[int, int, int]:
    """Corpus totals where each sentence, in order, takes the annotator that gives the best
    running F; then most hits, fewest false ones, fewest misses, the first annotator."""

    def rank(tp: int, fp: int, fn: int) -> tuple[float, int, int, int]:
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        b = beta * beta
        return ((1 + b) * p * r / (b * p + r) if p + r else 0.0, tp, -fp, -fn)

    total = (0, 0, 0)
    for options in counts:
        sums = [tuple(t + o for t, o in zip(total, option, strict=True)) for option in options]
        total = max(sums, key=lambda s: rank(*s))
    return total


def corpus_counts(rows: DataFrame, beta: float = 0.5) -> tuple[int, int, int]:
    """Corpus totals of rows (sid, annotator, tp, fp, fn). With one annotator a sentence they
    are plain sums; with several each sentence, in the order of sid, takes the annotator
    that is best for the running totals, so rows come to the driver as a stream of which
    it holds one sentence."""
    several = rows.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not several:
        row = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn")]).first()
        return tuple(row)
    options = F.array_sort(F.collect_list(F.struct("annotator", "tp", "fp", "fn")))
    ordered = rows.groupBy("sid").agg(options.alias("o")).orderBy("sid")
    total = (0, 0, 0)
    for row in ordered.toLocalIterator():
        total = annotator_fold([[total], [tuple(o)[1:] for o in row.o]], beta)
    return total
