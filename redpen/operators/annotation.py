"""Edits extracted from a sentence and its correction, both parsed, and their types.

Parsing is the caller's: sentences come with arrays of TOKEN structs (see ``injection``), so
any parser can stand before. What is a word comes as a column too (``known``, for each
source token whether the dictionary has it)."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the scheme: classes of words, thresholds, names of categories.
OPEN = {"ADJ", "ADV", "NOUN", "VERB"}
CARRIERS = OPEN | {"AUX"}
VERB_GROUP = {"AUX", "PART", "VERB"}
RENAMED = {"PROPN": "PNOUN", "CCONJ": "CONJ"}
RARE = {"INTJ", "NUM", "SYM", "X", "SPACE"}
INFLECTING = {"ADJ", "ADV", "AUX", "DET", "NOUN", "PRON", "VERB"}
VARIANT, SPELL, SHORT = 0.75, 0.55, 4
UNSTRESSED = str.maketrans("áéíóúÁÉÍÓÚ", "aeiouAEIOU")


@dataclass(frozen=True)
class Token:
    text: str
    lemma: str
    pos: str
    dep: str

    @property
    def lower(self) -> str:
        return self.text.lower()


@dataclass(frozen=True)
class Op:
    """A step of an alignment: its kind (M, T, S, D, I or X for several) and both spans."""

    kind: str
    begin: int
    end: int
    to: int
    upto: int


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence of two words."""
    y = np.array(list(b))
    row = np.zeros(len(b) + 1, np.int64)
    for c in a:
        step = np.where(y == c, row[:-1] + 1, row[1:])
        row = np.r_[0, np.maximum.accumulate(np.maximum(step, row[1:]))]
    return int(row[-1])


def indel_similarity(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 of two empty words."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def edit_similarity(a: str, b: str) -> float:
    """1 less the edit distance over the longer length."""
    steps = np.arange(len(b) + 1)
    row, y = steps.copy(), np.array(list(b))
    for i, c in enumerate(a, 1):
        best = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (y != c))] if len(b) else np.array([i])
        row = np.minimum.accumulate(best - steps) + steps
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


def substitution(a: Token, b: Token) -> float:
    """What it costs to put one token for another: nothing if only case differs, else a
    part for another lemma, one for another class, and one for other letters."""
    if a.lower == b.lower:
        return 0.0
    klass = 0.0 if a.pos == b.pos else 0.25 if a.pos in OPEN and b.pos in OPEN else 0.5
    return (0.0 if a.lemma == b.lemma else 0.499) + klass + 1 - indel_similarity(a.text, b.text)


def align(source: Sequence[Token], target: Sequence[Token]) -> list[Op]:
    """A cheapest alignment; equal costs go to a transposition, then a substitution, an
    insertion, a deletion. Transposed stretches have the same words in lower case."""
    n, m = len(source), len(target)
    cost = np.zeros((n + 1, m + 1))
    cost[:, 0], cost[0, :] = np.arange(n + 1), np.arange(m + 1)
    kind = np.full((n + 1, m + 1), "", dtype=object)
    kind[1:, 0], kind[0, 1:] = "D", "I"
    low, cor = [t.lower for t in source], [t.lower for t in target]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if source[i - 1].text == target[j - 1].text:
                cost[i, j], kind[i, j] = cost[i - 1, j - 1], "M"
                continue
            ways = [(np.inf, "T"), (cost[i - 1, j - 1] + substitution(source[i - 1], target[j - 1]), "S"), (cost[i, j - 1] + 1, "I"), (cost[i - 1, j] + 1, "D")]
            for k in range(2, min(i, j) + 1):
                if cost[i - k + 1, j - k + 1] == cost[i - k, j - k]:
                    break
                if sorted(low[i - k : i]) == sorted(cor[j - k : j]):
                    ways[0] = (cost[i - k, j - k] + k - 1, f"T{k}")
                    break
            cost[i, j], kind[i, j] = min(ways, key=lambda w: w[0])
    out, i, j = [], n, m
    while i or j:
        k = kind[i, j]
        a, b = {"D": (1, 0), "I": (0, 1)}.get(k, (int(k[1:] or 1),) * 2 if k[0] == "T" else (1, 1))
        out.append(Op(k[0], i - a, i, j - b, j))
        i, j = i - a, j - b
    return out[::-1]


def _one(ops: Sequence[Op]) -> list[Op]:
    """A run of steps as one."""
    return [Op("X", ops[0].begin, ops[-1].end, ops[0].to, ops[-1].upto)] if ops else []


def _marks(words: Sequence[Token]) -> str:
    return "".join(t.lower for t in words).replace("'", "").replace("-", "")


def _is_mark(t: Token) -> bool:
    return t.pos == "PUNCT" or t.text in string.punctuation


def _cut(run: Sequence[Op], a: int, b: int, old: Sequence[Token], new: Sequence[Token]) -> tuple[int, int, str] | None:
    """Where the first rule that fits steps a..b of a run parts it: (begin, end, what
    becomes of the steps between: ``one`` edit, ``apart`` or ``kept`` as they are)."""
    first, last = run[a], run[b]
    if old[-1].lower == new[-1].lower:
        alone = (len(old) == 1 and new[0].text[:1].isupper()) or (len(new) == 1 and old[0].text[:1].isupper())
        if a == 0 and alone:
            return 0, b + 1, "one"
        if (len(old) > 1 and _is_mark(old[-2])) or (len(new) > 1 and _is_mark(new[-2])):
            return b - 1, b + 1, "one"
    classes = {t.pos for t in (*old, *new)}
    regrouped = len(old) != len(new) and (len(classes) == 1 or classes <= VERB_GROUP)
    if _marks(old) == _marks(new) or regrouped:
        return a, b + 1, "one"
    if b - a < 2:
        near = lambda op, x, y: op.kind == "S" and indel_similarity(x.text, y.text) > VARIANT
        if len(old) == len(new) == 2 or near(first, old[0], new[0]) or near(last, old[-1], new[-1]):
            return a + 1, a + 1, "apart"
        closing = (run[-1].kind in "DS" and old[-1].pos == "DET") or (run[-1].kind in "IS" and new[-1].pos == "DET")
        if b == len(run) - 1 and closing:
            return b, b + 1, "kept"
    return None


def merged(run: Sequence[Op], source: Sequence[Token], target: Sequence[Token]) -> list[Op]:
    """A run of deletions, insertions and substitutions as edits: a stack of stretches is
    parted by the rules, widest stretch first, until none applies. A stretch without any
    rule is one edit if it touches a content word, else its steps are edits."""
    done: list[Op] = []
    stack: list[tuple[str, list[Op]]] = [("open", list(run))]
    while stack:
        state, ops = stack.pop()
        if state == "kept" or len(ops) <= 1:
            done += ops
            continue
        if state == "one" or {o.kind for o in ops} in ({"D"}, {"I"}):
            done += _one(ops)
            continue
        content, found = False, None
        for width in range(len(ops) - 1, 0, -1):
            for a in range(len(ops) - width):
                b = a + width
                if not any(o.kind == "S" for o in ops[a : b + 1]):
                    continue
                old, new = source[ops[a].begin : ops[b].end], target[ops[a].to : ops[b].upto]
                found = _cut(ops, a, b, old, new)
                if found:
                    break
                content = content or any(t.pos in CARRIERS for t in (*old, *new))
            if found:
                break
        if found is None:
            done += _one(ops) if content else ops
            continue
        begin, end, what = found
        parts = [("open", ops[:begin]), (what, ops[begin:end]), ("open", ops[end:])]
        stack += [p for p in reversed(parts) if p[1]]
    return done


def _category(t: Token) -> str:
    return RENAMED.get(t.pos, t.pos)


def one_sided(words: Sequence[Token]) -> str:
    """The category of tokens that are put in or taken out."""
    kinds = {_category(t) for t in words}
    if len(kinds) == 1 and not kinds & RARE:
        return kinds.pop()
    if {t.dep for t in words} <= {"oc", "aux"} and kinds <= {"AUX", "VERB"}:
        return "AUX"
    return "VERB" if kinds == {"PART", "VERB"} else "OTHER"


def two_sided(old: Sequence[Token], new: Sequence[Token], known: bool, language: str) -> str:
    """The category of tokens that stand for others; ``known`` is whether the first old
    token is a word."""
    fold = (lambda s: s.translate(UNSTRESSED)) if language == "es" else (lambda s: s)
    joined = lambda words: fold("".join(t.lower for t in words))
    if joined(old) == joined(new):
        return "ORTH"
    if sorted(t.lower for t in old) == sorted(t.lower for t in new):
        return "WO"
    kinds = {_category(t) for t in (*old, *new)}
    plain = kinds.pop() if len(kinds) == 1 and not kinds & RARE else "OTHER"
    if len(old) > 1 or len(new) > 1:
        return plain
    a, b = old[0], new[0]
    if a.lemma == b.lemma:
        if _category(a) != _category(b):
            return "MORPH"
        return _category(a) + (":FORM" if _category(a) in INFLECTING else "")
    if a.text.isalpha() and not known:
        if edit_similarity(a.lower, b.lower) > SPELL or max(len(a.text), len(b.text)) <= SHORT:
            return "SPELL"
        return "OTHER" if _category(b) in RARE else _category(b)
    return plain


def error_type(old: Sequence[Token], new: Sequence[Token], known: bool, language: str) -> str | None:
    """The type of an edit; none if it changes nothing. Last tokens that differ in case
    alone came along with what stands before them."""
    while True:
        if [t.text for t in old] == [t.text for t in new]:
            return None
        if not old or not new:
            return f"M:{one_sided(new)}" if new else f"U:{one_sided(old)}"
        if old[-1].lower != new[-1].lower or (len(old) == 1 and len(new) == 1):
            return f"R:{two_sided(old, new, known, language)}"
        old, new = old[:-1], new[:-1]


def extract(source: Sequence[Token], target: Sequence[Token], known: Sequence[bool], language: str = "de") -> list[tuple[int, int, str, str]]:
    """Edits (start, end, error_type, correction) that turn the source into the target."""
    out = []
    for kind, steps in groupby(align(source, target), lambda o: o.kind if o.kind in "MT" else ""):
        if kind == "M":
            continue
        for o in steps if kind == "T" else merged(list(steps), source, target):
            old, new = source[o.begin : o.end], target[o.to : o.upto]
            name = error_type(old, new, bool(known[o.begin]) if o.begin < len(known) else True, language)
            if name:
                out.append((o.begin, o.end, name, " ".join(t.text for t in new)))
    return out


EDITS = "array<struct<start:int,end:int,error_type:string,correction:string>>"


def annotate(pairs: DataFrame, language: str = "de", id_col: str = "sid", source: str = "source", target: str = "target", known: str = "known") -> DataFrame:
    """Rows (id, edits) of pairs with parsed ``source`` and ``target`` (arrays of TOKEN) and
    ``known`` (whether each source token is a word; null: all are). A null parse has no tokens."""
    kind = pairs.schema[id_col].dataType.simpleString()

    def read(parse) -> list[Token]:
        return [] if parse is None else [Token(t["text"] or "", t["lemma"] or "", t["pos"] or "", t["dep"] or "") for t in parse]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            edits = [
                [dict(zip(("start", "end", "error_type", "correction"), e, strict=True)) for e in extract(read(s), read(t), [] if k is None else list(k), language)]
                for s, t, k in zip(part["s"], part["t"], part["k"], strict=True)
            ]
            yield pd.DataFrame({id_col: part[id_col], "edits": edits})

    rows = pairs.select(id_col, F.col(source).alias("s"), F.col(target).alias("t"), F.col(known).alias("k"))
    return rows.mapInPandas(run, f"`{id_col}` {kind}, edits {EDITS}")


def known_words(words: DataFrame, dictionary: DataFrame, id_col: str = "sid", tokens_col: str = "tokens") -> DataFrame:
    """Rows (id, known): for each token whether the dictionary (column ``word``) has it."""
    each = words.select(id_col, F.posexplode(tokens_col).alias("i", "word"))
    found = each.join(dictionary.select("word").distinct().withColumn("is_word", F.lit(True)), "word", "left")
    flags = F.array_sort(F.collect_list(F.struct("i", F.coalesce("is_word", F.lit(False)).alias("k"))))
    return found.groupBy(id_col).agg(F.transform(flags, lambda x: x["k"]).alias("known"))


def fragment_parser(parse: Callable[[Column], Column]) -> Callable[[DataFrame, str], DataFrame]:
    """A parser plugged in: ``parse`` makes an array of TOKEN of a text column; distinct
    texts are parsed once and joined back."""

    def run(rows: DataFrame, text: str) -> DataFrame:
        once = rows.select(text).distinct().withColumn("parse", parse(F.col(text)))
        return rows.join(once, text, "left")

    return run


def differences(source: Sequence[str], target: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Runs (same, del or ins; tokens) of a longest common subsequence of two token lists;
    of equal choices a deletion comes first."""
    n, m = len(source), len(target)
    keep = np.zeros((n + 1, m + 1), np.int64)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            keep[i, j] = keep[i + 1, j + 1] + 1 if source[i] == target[j] else max(keep[i + 1, j], keep[i, j + 1])
    out: list[tuple[str, list[str]]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and source[i] == target[j]:
            step = ("same", source[i])
            i, j = i + 1, j + 1
        elif i < n and (j == m or keep[i + 1, j] >= keep[i, j + 1]):
            step = ("del", source[i])
            i += 1
        else:
            step = ("ins", target[j])
            j += 1
        if out and out[-1][0] == step[0]:
            out[-1][1].append(step[1])
        else:
            out.append((step[0], [step[1]]))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])))
def differences_udf(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "tokens": t} for k, t in differences(list(a), list(b))] for a, b in zip(source, target, strict=True)])


def changes(runs: Column) -> Column:
    """(wrong, right) of every stretch of runs that isn't the same, in order."""
    numbered = F.transform(runs, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    begins = F.filter(numbered, lambda x: (x["r"]["kind"] != "same") & ((x["i"] == 0) | (F.get(runs, x["i"] - 1)["kind"] == "same")))
    side = lambda x, kind: F.array_join(
        F.flatten(F.transform(F.filter(F.array(x["r"], F.get(runs, x["i"] + 1)), lambda r: r.isNotNull() & (r["kind"] == kind)), lambda r: r["tokens"])), " "
    )
    return F.transform(begins, lambda x: F.struct(side(x, "del").alias("wrong"), side(x, "ins").alias("right")))


def shape_of(wrong: Column, right: Column) -> Column:
    """An edit told from its shape alone: missing, unnecessary, spelling, or replaced."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", "")
    return F.when(wrong == "", "missing").when(right == "", "unnecessary").when(letters(wrong) == letters(right), "spelling").otherwise("replaced")
