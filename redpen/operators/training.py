"""Training records: answers as JSON, parsing them back, union of sources, padding."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import apply, edits_for, occurrences
from ..functions.text import assign_split, tokens
from .governance import training_split
from .scoring import mark_moves

ANSWER = "correction string, changes array<struct<was:string,now:string,type:string>>"
CHANGES = "array<struct<was:string,now:string,type:string>>"
#: How far a quoted window may widen on each side to stand but once.
CONTEXT = 3

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPES |= {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in _ESCAPES}


def quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters are escaped, nothing else."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = text
    for c, e in _ESCAPES.items():
        full = F.replace(full, F.lit(c), F.lit(e))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), full).otherwise(plain), F.lit('"'))


def build_answer(correction: Column, changes: Column) -> Column:
    """``{"correction": .., "changes": [{"was": .., "now": .., "type": ..}]}`` with a space
    after each comma and colon."""
    one = lambda c: F.concat(F.lit('{"was": '), quoted(c["was"]), F.lit(', "now": '), quoted(c["now"]), F.lit(', "type": '), quoted(c["type"]), F.lit("}"))
    return F.concat(F.lit('{"correction": '), quoted(correction), F.lit(', "changes": ['), F.array_join(F.transform(changes, one), ", "), F.lit("]}"))


def anchor(words: Column, edit: Column, context: int = CONTEXT) -> Column:
    """(was, now): the words of the narrowest window around an edit that stands but once in
    the sentence, and what becomes of it; the widest window if none does. A window has a
    token at least, so an insertion takes in a neighbour."""
    size = F.size(words)

    def window(pad: Column) -> Column:
        begin, end = F.greatest(edit["start"] - pad, F.lit(0)), F.least(edit["end"] + pad, size)
        return F.struct(begin.alias("a"), end.alias("b"), F.slice(words, begin + 1, F.greatest(end - begin, F.lit(0))).alias("w"))

    windows = F.transform(F.sequence(F.lit(0), F.lit(context)), window)
    once = F.filter(windows, lambda w: (F.size(w["w"]) > 0) & (occurrences(words, w["w"]) == 1))
    best = F.coalesce(F.get(once, F.lit(0)), F.get(windows, F.lit(context)))
    part = lambda a, b: F.slice(words, a + 1, F.greatest(b - a, F.lit(0)))
    now = F.concat(part(best["a"], edit["start"]), tokens(edit["correction"]), part(edit["end"], best["b"]))
    return F.struct(F.array_join(best["w"], " ").alias("was"), F.array_join(now, " ").alias("now"))


def build_target(words: Column, target: Column, edits: Column) -> Column:
    """The answer that a record (source tokens, target, edits in order) teaches."""
    made = F.transform(edits, lambda e: F.struct(anchor(words, e).alias("a"), e["error_type"].alias("type")))
    return build_answer(target, F.transform(made, lambda m: F.struct(m["a"]["was"].alias("was"), m["a"]["now"].alias("now"), m["type"].alias("type"))))


def parse_answer(text: Column) -> Column:
    """The answer as a struct (correction, changes, complete); of a broken one the
    correction is salvaged, without changes; null if there is none."""
    whole = F.from_json(F.trim(text), ANSWER)
    none = F.array().cast(CHANGES)
    part = F.regexp_extract(text, r'"correction"\s*:\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")', 1)
    full = F.struct(whole["correction"].alias("correction"), F.coalesce(whole["changes"], none).alias("changes"), F.lit(True).alias("complete"))
    salvaged = F.from_json(F.concat(F.lit('{"correction": '), part, F.lit("}")), "correction string")["correction"]
    rest = F.struct(salvaged.alias("correction"), none.alias("changes"), F.lit(False).alias("complete"))
    return F.when(whole["correction"].isNotNull(), full).when((part != "") & salvaged.isNotNull(), rest)


RECORD_EDIT = "struct<start:int,end:int,error_type:string,correction:string,rule:string,explanation:string>"


@dataclass(frozen=True)
class Templates:
    """Texts by rule (with an optional reference each), by error type, operation and
    category; ``{wrong}``, ``{right}`` and ``{category}`` stand for an edit's own."""

    rules: dict[str, str] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)
    checker: dict[str, str] = field(default_factory=dict)
    citation: str = ""
    explicit: dict[str, str] = field(default_factory=dict)
    operations: dict[str, str] = field(default_factory=dict)
    categories: dict[str, str] = field(default_factory=dict)
    fallback: str = ""
    move: str = ""


def load_templates(rules: str | None = None, types: str | None = None) -> Templates:
    """Templates of a file by rule and one by type, YAML (where its library is installed) or
    JSON; a missing file raises FileNotFoundError."""

    def read(path: str | None) -> dict:
        if path is None:
            return {}
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                return json.load(f)
            import yaml

            return yaml.safe_load(f)

    a, b = read(rules), read(types)
    text = lambda d: {k: v["explanation"].strip() if isinstance(v, dict) else v.strip() for k, v in (d or {}).items()}
    references = {k: v["reference"] for k, v in (a.get("corruptors") or {}).items() if isinstance(v, dict) and v.get("reference")}
    return Templates(
        text(a.get("corruptors")), references, text(a.get("languagetool")), a.get("edition", ""), text(b.get("explicit")), text(b.get("operations")),
        dict(b.get("categories") or {}), b.get("fallback", "").strip(), b.get("move", "").strip(),
    )


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")


def _filled(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def explained_type(kind: Column, wrong: Column, right: Column, t: Templates) -> Column:
    """The text of an edit by its type: the type's own, else its operation's (``R:FORM`` for
    another form, ``R`` where there is none) with the category's name, else the fallback."""
    parts = F.split(kind, ":")
    category = _map(t.categories)[F.coalesce(F.get(parts, F.lit(1)), F.lit("OTHER"))]
    operation = F.when(F.get(parts, F.lit(2)) == "FORM", "R:FORM").when(F.size(parts) > 1, parts[0]).otherwise("R")
    general = F.coalesce(_map(t.operations)[operation], F.lit(t.operations.get("R", "")))
    text = F.coalesce(_map(t.explicit)[kind], F.when(category.isNotNull(), _filled(general, category=category)), F.lit(t.fallback))
    return F.trim(_filled(text, wrong=wrong, right=right))


def explained_rule(rule: Column, wrong: Column, right: Column, t: Templates, checker_rule: Column | None = None) -> Column:
    """The text of an error by the rule that made it, what a checker's rule adds, and the
    reference. A rule without a template raises."""
    own = F.coalesce(_map(t.rules)[rule], F.raise_error(F.concat(F.lit("no template for rule "), rule)).cast("string"))
    more = _map(t.checker)[checker_rule] if checker_rule is not None else F.lit(None).cast("string")
    text = F.concat_ws(" ", _filled(own, wrong=wrong, right=right), _filled(more, wrong=wrong, right=right))
    head = F.lit(f"{t.citation}, " if t.citation else "")
    return F.concat(text, F.coalesce(F.concat(F.lit(" ("), head, _map(t.references)[rule], F.lit(")")), F.lit("")))


def training_records(sentences: DataFrame, templates: Templates, origin: str) -> DataFrame:
    """Records (sid, source, target, edits as RECORD_EDIT) of sentences (sid, tokens, edits
    of one annotator without noops), every edit explained by its type. Of a deletion and an
    insertion of the same word and category both are told as one move, and their rule is
    ``origin``-move; of several with one key the last counts."""
    def told(w: Column) -> Column:
        wrong = lambda e: F.array_join(F.slice(w, e["start"] + 1, F.greatest(e["end"] - e["start"], F.lit(0))), " ")
        return F.transform("edits", lambda e, i: F.struct(i.alias("ordinal"), *[e[f].alias(f) for f in ("start", "end", "error_type", "correction")], wrong(e).alias("wrong")))

    # held in an array of one, the tokens are found once, not for each edit
    each = sentences.select("sid", F.explode(F.transform(F.array("tokens"), told)[0]).alias("e")).select("sid", "e.*")
    words = F.when(F.startswith("error_type", F.lit("U:")), F.col("wrong")).otherwise(F.col("correction"))
    each = mark_moves(each.withColumn("words", words))
    text = F.when(F.col("moved"), _filled(F.lit(templates.move), word=F.col("words"))).otherwise(explained_type(F.col("error_type"), F.col("wrong"), F.col("correction"), templates))
    each = each.withColumn("rule", F.when(F.col("moved"), f"{origin}-move").otherwise(origin)).withColumn("explanation", text)
    fields = ("start", "end", "error_type", "correction", "rule", "explanation")
    made = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    held = each.groupBy("sid").agg(made.cast(f"array<{RECORD_EDIT}>").alias("told"))
    target = F.array_join(apply(F.col("tokens"), F.transform("edits", lambda e: e.withField("annotator", F.lit(0))), strict=False), " ")
    rows = sentences.select("sid", F.array_join("tokens", " ").alias("source"), target.alias("target"))
    return rows.join(held, "sid", "left").select("sid", "source", "target", F.coalesce("told", F.array().cast(f"array<{RECORD_EDIT}>")).alias("edits"))


def learner_records(load, split: str, templates: Templates, origin: str = "learner", limit: int | None = None) -> DataFrame:
    """``training_records`` of a corpus' train split; another split raises before it is read.
    ``load`` gives (sid, tokens, edits) of a split by its name."""
    rows = load(training_split(split))
    rows = rows.where(F.col("sid") < limit) if limit is not None else rows
    return training_records(rows.withColumn("edits", edits_for(F.col("edits"))), templates, origin)


def reversed_records(rows: DataFrame) -> DataFrame:
    """Sentences (sid, tokens, edits) the other way round, to learn to make errors: correct,
    learner, count (of edits that change something)."""
    own = edits_for(F.col("edits"))
    return rows.select("sid", F.array_join(apply(F.col("tokens"), own), " ").alias("correct"), F.array_join("tokens", " ").alias("learner"), F.size(own).alias("count"))


def align_essays(essays: DataFrame, split: Callable[[Column], Column]) -> DataFrame:
    """Essays with ``pairs`` (index, source, target, target2): sentences of the essay beside
    those of its correction, null where their numbers differ; of a second correction only
    where its number agrees. ``split`` makes an array of sentences of a text column."""
    src, tgt, second = (split(F.col(c)) for c in ("essay", "corrected1", "corrected2"))
    fits = (F.size(src) == F.size(tgt)) & (F.col("corrected1") != "")
    other = F.coalesce((F.col("corrected2") != "") & (F.size(second) == F.size(src)), F.lit(False))
    pairs = F.transform(src, lambda s, i: F.struct(i.alias("index"), s.alias("source"), F.get(tgt, i).alias("target"), F.when(other, F.get(second, i)).alias("target2")))
    return essays.withColumn("pairs", F.when(F.coalesce(fits, F.lit(False)), pairs))


def essay_pairs(essays: DataFrame, split: Callable[[Column], Column], salt: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The aligned pairs of all essays, by the split of their learner, and the counts of
    essays: all, corrected, aligned, dropped for their numbers of sentences."""
    aligned = align_essays(essays, split)
    corrected = F.coalesce(F.col("corrected1") != "", F.lit(False))
    counts = aligned.agg(F.count("*").alias("essays"), F.count_if(corrected).alias("corrected"), F.count("pairs").alias("aligned"), F.count_if(corrected & F.col("pairs").isNull()).alias("dropped"))
    others = [c for c in essays.columns if c not in ("essay", "corrected1", "corrected2")]
    rows = aligned.select(*others, assign_split(F.col(id_col), salt).alias("split"), F.explode("pairs").alias("p")).select(*others, "split", "p.*")
    return rows, counts


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All records with the name of their source."""
    parts = [d.withColumn("source_kind", F.lit(name)) for name, d in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def pad(ids: Column, to: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(to - F.size(ids), F.lit(0))))


def explain_type(edits: DataFrame, explicit: DataFrame, operations: DataFrame, fallback: str) -> DataFrame:
    """A text for each edit type: its own, else its operation's with the category's name,
    else the fallback. ``:FORM`` types take the operation ``FORM``. The templates are
    small tables; the planner broadcasts them by their size."""
    parts = F.split("error_type", ":")
    op = F.when(F.endswith("error_type", F.lit(":FORM")), F.lit("FORM")).otherwise(parts[0])
    rows = edits.withColumn("op", op).withColumn("category", F.lower(F.coalesce(F.get(parts, 1), F.lit(""))))
    rows = rows.join(explicit.withColumnRenamed("text", "own"), "error_type", "left").join(operations.withColumnRenamed("text", "general"), "op", "left")
    filled = F.replace(F.col("general"), F.lit("{category}"), F.col("category"))
    return rows.withColumn("explanation", F.coalesce("own", filled, F.lit(fallback))).drop("own", "general", "op", "category")


def apply_matches(text: Column, matches: Column) -> Column:
    """A checker's first replacements put into a text: by character offsets, from the left,
    those that don't overlap an earlier one and change something."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, m: Column) -> Column:
        found = F.substring(text, m["offset"] + 1, m["length"])
        fits = (m["offset"] >= s["at"]) & m["replacement"].isNotNull() & (m["replacement"] != found)
        gap = F.substring(text, s["at"] + 1, m["offset"] - s["at"])
        return F.when(fits, F.struct((m["offset"] + m["length"]).alias("at"), F.concat(s["out"], gap, m["replacement"]).alias("out"))).otherwise(s)

    end = F.aggregate(F.array_sort(matches), start, step)
    return F.concat(end["out"], F.substring(text, end["at"] + 1, F.char_length(text)))
