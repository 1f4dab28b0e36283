import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from redpen.functions import edits, prompts, text
from redpen.operators import annotation, checker, clean, correctors, encoding, explanations, injection, kernels, leniency, rerank, reports, samples, training, vocabulary

CLAIMS = "array<struct<was:string,now:string,type:string>>"
EDITS = "array<struct<start:int,end:int,error_type:string,correction:string>>"


@pytest.mark.parametrize(
    ("claims", "counts"),
    [
        ([("roten", "rote", "R:ADJ:FORM")], (2, 1, 1, 1, 1, 1)),
        ([], (2, 0, 0, 0, 0, 0)),
        ([("fehlt", "x", "R:ADJ:FORM"), ("", "x", "R:ADJ:FORM")], (2, 2, 0, 0, 0, 0)),
        # the replacement is spoken as a token, not within another; an empty one isn't
        ([("der roten", "in Kinder rote", "R:ADJ:FORM")], (2, 1, 1, 1, 1, 1)),
        ([("der", "in", "R:DET")], (2, 1, 1, 1, 1, 1)),
        ([("Wagen", "Wagen", "R:NOUN")], (2, 1, 1, 0, 0, 0)),
    ],
)
def test_explanations(spark, claims, counts):
    own = [(0, 1, "R:DET", "in"), (1, 2, "R:ADJ:FORM", "rote")]
    row = spark.createDataFrame([("der roten Wagen".split(), own, claims)], f"w array<string>, e {EDITS}, c {CLAIMS}")
    assert tuple(row.select(explanations.explained(F.col("w"), F.col("e"), F.col("c")).alias("x")).first().x) == counts


def test_insertion_touches_borders(spark):
    edit = F.struct(F.lit(3).alias("start"), F.lit(3).alias("end"))
    row = spark.range(1).select(explanations.touches(F.lit(2), F.lit(3), edit).alias("a"), explanations.touches(F.lit(4), F.lit(5), edit).alias("b")).first()
    assert (row.a, row.b) == (True, False)


def test_quoted_is_json(spark):
    raw = "a\tb\r\n\x0b\x1f\"\\ü\x7f"
    assert spark.createDataFrame([(raw,)], "t string").select(training.quoted(F.col("t")).alias("q")).first().q == json.dumps(raw, ensure_ascii=False)


def test_anchor(spark):
    words = "die Frau und die Katze sah die Frau".split()
    rows = [(0, 1, "eine"), (5, 5, "gestern"), (7, 8, "Tochter")]
    got = spark.createDataFrame([(words, *r) for r in rows], "w array<string>, start int, end int, correction string")
    out = got.select(training.anchor(F.col("w"), F.struct("start", "end", "correction")).alias("a")).collect()
    assert [tuple(r.a) for r in out] == [("die Frau und", "eine Frau und"), ("Katze sah", "Katze gestern sah"), ("sah die Frau", "sah die Tochter")] or [tuple(r.a) for r in out][1:] == [("Katze sah", "Katze gestern sah"), ("die Frau", "die Tochter")]


def test_records_tell_moves(spark):
    rows = spark.createDataFrame([(1, ["gern", "esse", "ich"], [(0, 1, "U:ADV", "", 0), (1, 2, "R:VERB", "trinke", 0), (3, 3, "M:ADV", "gern", 0)])], "sid int, tokens array<string>, edits array<struct<start:int,end:int,error_type:string,correction:string,annotator:int>>")
    t = training.Templates(explicit={"R:VERB": "{wrong} is {right}."}, operations={"U": "too many", "M": "missing", "R": "?"}, categories={"ADV": "adverb"}, move="{word} moves.")
    row = training.training_records(rows, t, "x").first()
    assert row.target == "trinke ich gern" and [(e.rule, e.explanation) for e in row.edits] == [("x-move", "gern moves."), ("x", "esse is trinke."), ("x-move", "gern moves.")]
    with pytest.raises(Exception, match="isn't for training"):
        training.learner_records(None, "dev", t)


def _token(text, lemma, pos, dep="x", tag="", head=0, **morph):
    return {"text": text, "lemma": lemma, "pos": pos, "dep": dep, "tag": tag, "head": head, "morph": morph}


def _parse(spec):
    return [annotation.Token(*x.split("/")[:3], (x.split("/") + [""])[3]) for x in spec.split()]


@pytest.mark.parametrize(
    ("source", "target", "known", "expected"),
    [
        ("Ich/ich/PRON gehe/gehen/VERB", "Ich/ich/PRON gehe/gehen/VERB", [1, 1], []),
        ("das/der/DET auto/auto/NOUN", "das/der/DET Auto/Auto/NOUN", [1, 1], [(1, 2, "R:ORTH", "Auto")]),
        ("er/er/PRON gehen/gehen/VERB", "er/er/PRON geht/gehen/VERB", [1, 1], [(1, 2, "R:VERB:FORM", "geht")]),
        ("mit/mit/ADP", "in/in/ADP", [1], [(0, 1, "R:ADP", "in")]),
        ("Hausß/Hausß/NOUN", "Haus/Haus/NOUN", [0], [(0, 1, "R:SPELL", "Haus")]),
        ("er/er/PRON kam/kommen/VERB", "er/er/PRON gestern/gestern/ADV kam/kommen/VERB", [1, 1], [(1, 1, "M:ADV", "gestern")]),
        ("er/er/PRON ,/,/PUNCT kam/kommen/VERB", "er/er/PRON kam/kommen/VERB", [1, 1, 1], [(1, 2, "U:PUNCT", "")]),
        ("statt/statt/ADP dessen/der/PRON", "stattdessen/stattdessen/ADV", [1, 1], [(0, 2, "R:ORTH", "stattdessen")]),
        ("ich/ich/PRON heute/heute/ADV", "heute/heute/ADV ich/ich/PRON", [1, 1], [(0, 2, "R:WO", "heute ich")]),
        ("habe/haben/AUX/oc gegessen/essen/VERB/oc", "aß/ass/VERB", [1, 1], [(0, 2, "R:OTHER", "aß")]),
    ],
)
def test_typed_edits(source, target, known, expected):
    assert annotation.extract(_parse(source), _parse(target), known) == expected


def test_edits_rebuild_the_target():
    rng = np.random.default_rng(1)
    words = [annotation.Token(w, w.lower()[:2], p, "x") for w in ("der", "Der", "alte", "Alte", "Hund", "hund", "läuft", "lauft", ",", "und") for p in ("NOUN", "VERB", "DET", "PUNCT")]
    for _ in range(300):
        a, b = ([words[i] for i in rng.integers(0, len(words), rng.integers(0, 9))] for _ in range(2))
        out = [t.text for t in a]
        for start, end, _, correction in reversed(annotation.extract(a, b, [True] * len(a))):
            out[start:end] = correction.split()
        assert out == [t.text for t in b]


def test_annotate_and_known_words(spark):
    rows = spark.createDataFrame([(1, [_token("eine", "ein", "DET")], [_token("ein", "ein", "DET")], None), (2, None, [_token("ja", "ja", "INTJ")], [])], f"sid int, source array<{injection.TOKEN}>, target array<{injection.TOKEN}>, known array<boolean>")
    assert {r.sid: [tuple(e) for e in r.edits] for r in annotation.annotate(rows).collect()} == {1: [(0, 1, "R:DET:FORM", "ein")], 2: [(0, 0, "M:OTHER", "ja")]}
    words = spark.createDataFrame([(1, ["a", "x"])], "sid int, tokens array<string>")
    assert annotation.known_words(words, spark.createDataFrame([("a",)], "word string")).first().known == [True, False]


def test_differences(spark):
    row = spark.createDataFrame([("a b c d".split(), "a x c".split())], "s array<string>, t array<string>").withColumn("r", annotation.differences_udf("s", "t")).select(annotation.changes(F.col("r")).alias("c")).first()
    assert [tuple(x) for x in row.c] == [("b", "x"), ("d", "")]


EDIT = "sid int, start int, end int, correction string, error_type string, ordinal int"


def test_lenient_pairs_are_one_to_one(spark):
    gold = spark.createDataFrame([(1, 0, 1, "Chemie-Studentin", "R:NOUN", 0), (1, 2, 2, "a-b", "M:X", 1)], EDIT)
    system = spark.createDataFrame([(1, 0, 1, "Chemiestudentin", "R:ORTH", 0), (1, 2, 2, "ab", "M:Y", 1), (1, 2, 2, "AB", "M:Z", 2)], EDIT)
    got = sorted((r.start, r.gold_type or "", r.system_type or "") for r in leniency.lenient_join(gold, system).collect())
    assert got == [(0, "R:NOUN", "R:ORTH"), (2, "", "M:Z"), (2, "M:X", "M:Y")]
    assert leniency.lenient_join(gold, system, compounds=False).where("gold_type is not null and system_type is not null").count() == 0


def test_synonyms(spark):
    parse = lambda word, lemma, **m: [_token(word, lemma, "NOUN", **m)]
    kind = f"id int, gold_parse array<{injection.TOKEN}>, system_parse array<{injection.TOKEN}>"
    rows = [(1, parse("Ökonomie", "Ökonomie", Number="Sing"), parse("Wirtschaft", "Wirtschaft", Number="Sing")), (2, parse("Zwänge", "Zwang", Number="Plur"), parse("Druck", "Druck", Number="Sing")), (3, parse("Hund", "Hund"), parse("Katze", "Katze")), (4, [], [])]
    edges = spark.createDataFrame([("ökonomie", "wirtschaft"), ("zwang", "druck")], "word string, synonym string")
    assert [r.id for r in leniency.synonymous(spark.createDataFrame(rows, kind), edges).collect()] == [1]


def test_folding(spark):
    row = spark.createDataFrame([("u\u0308ber\u00a0„a“ ‚b", "a–b", "ab")], "s string, d string, c string").select(leniency.folded(F.col("s")).alias("f"), text.same_compound(F.col("d"), F.col("c")).alias("c")).first()
    assert (row.f, row.c) == ('über "a" ‚b', True)


def _sentence(spark, *tokens):
    return spark.createDataFrame([(1, [t["text"] for t in tokens], list(tokens))], f"sid int, tokens array<string>, parse array<{injection.TOKEN}>")


def _found(spark, lang, words, *tokens):
    known = spark.createDataFrame([(w,) for w in words.split()], "word string")
    return {(r.rule, r.start, r.end, r.correction) for r in injection.with_dictionary(_sentence(spark, *tokens), known, parse="parse", lang=lang).collect()}


def test_german_rules_with_a_parse(spark):
    t = _token
    got = _found(spark, "de", "fahren Haus", t("Wir", "wir", "PRON", tag="PPER"), t("fahrt", "fahren", "VERB", "ROOT", "VVFIN", 1), t("des", "der", "DET", tag="ART"), t("kleinen", "klein", "ADJ", tag="ADJA"), t("Hauses", "Haus", "NOUN", tag="NN", Case="Gen", Number="Sing"), t("ab", "ab", "ADP", tag="PTKVZ", head=1))
    assert {("verb_infinitive", 1, 2, "fahren"), ("comma_after_fronted", 1, 1, ","), ("noun_case", 4, 5, "hauses"), ("genitive_s", 4, 5, "Haus"), ("adjective_form", 3, 4, "kleines"), ("separable_prefix", 1, 6, "abfahrt des kleinen Hauses")} <= got
    got = _found(spark, "de", "", t("dass", "dass", "SCONJ", tag="KOUS", head=4), t("er", "er", "PRON", "sb", "PPER", 4), t("morgen", "morgen", "ADV"), t("hin", "hin", "ADV"), t("hat", "haben", "AUX", tag="VAFIN", head=4), t("gesehen", "sehen", "VERB", tag="VVPP", head=4))
    assert {("verb_final", 1, 5, "er hat morgen hin"), ("drop_pronoun", 1, 2, ""), ("auxiliary_form", 4, 5, "habe"), ("drop_auxiliary", 4, 5, "")} <= got


def test_spanish_rules_with_a_parse(spark):
    t = _token
    got = _found(spark, "es", "rojas rojo hablar", t("Que", "que", "SCONJ"), t("sea", "ser", "AUX", "cop", head=2, Mood="Sub", VerbForm="Fin", Person="1", Number="Sing"), t("roja", "rojo", "ADJ"), t("hablo", "hablar", "VERB", VerbForm="Fin", Person="1", Number="Sing", head=3), t("la", "el", "DET"), t("es", "ser", "AUX", "cop", head=2))
    assert {("subjunctive_for_indicative", 1, 2, "es"), ("adjective_form", 2, 3, "rojo"), ("adjective_form", 2, 3, "rojas"), ("verb_infinitive", 3, 4, "hablar"), ("redundant_subject_pronoun", 3, 3, "yo"), ("article_form", 4, 5, "los"), ("drop_article", 4, 5, ""), ("ser_estar", 5, 6, "está"), ("keyboard", 3, 4, "gablo")} <= got
    assert not _found(spark, "es", "gablo", t("hablo", "hablar", "X"))


def test_checker(spark):
    payload = json.dumps({"matches": [{"message": "m", "offset": 4, "length": 3, "replacements": [{"value": "kam"}], "rule": {"id": "R", "issueType": "t", "category": {"id": "C"}}}]})
    rows = spark.createDataFrame([(1, "er  kma")], "sid int, text string")
    cache = spark.createDataFrame([], "key string, text string, matches string")
    out = correctors.build("checker", lambda texts: [payload] * len(texts), cache, "1", "de")(rows)
    assert out.first().text == "er  kam"
    one = spark.createDataFrame([(payload,)], "p string").select(checker.from_response(F.col("p"))[0].alias("m")).select(checker.excerpt(F.lit("er  kma"), F.col("m")).alias("e"), checker.best_replacement(F.col("m")).alias("b")).first()
    assert (one.e, one.b) == ("kma", "kam")
    fetched, fresh = checker.checked(rows.unionByName(rows), cache, lambda texts: [payload] * len(texts), "1", "de")
    assert fetched.count() == 2 and fresh.count() == 1


def test_correctors(spark):
    rows = spark.createDataFrame([(1, "das auto"), (2, "gut")], "sid int, text string")
    assert correctors.build("identity")(rows).count() == 2
    prompted = correctors.build("prompted", lambda p: [x.split("Input: ")[-1].split("\n")[0].upper() + "\nInput: x" for x in p], [("a", "b")])
    assert {r.text for r in prompted(rows).collect()} == {"DAS AUTO", "GUT"}
    answer = lambda p: ['{"correction": "das Auto", "changes": []' if "auto" in x else "?" for x in p]
    tuned = correctors.build("finetuned", answer, rounds=2)
    assert {r.sid: r.text for r in tuned(rows).collect()} == {1: "das Auto", 2: "gut"}
    assert tuple(tuned.faults(rows).first()) == (2, 1, 1, 0)
    with pytest.raises(KeyError, match="known"):
        correctors.build("none")


def test_samples(spark):
    rows = spark.createDataFrame([(i, "a b c d".split(), ("a b x d" if i % 4 == 1 else "y y y y" if i % 4 else "a b c d").split(), i % 4) for i in range(60)], "sid int, tokens array<string>, target_tokens array<string>, n_edits int")
    got = samples.shots(rows, 8, "s").collect()
    assert len(got) == 8 and sum(r.n_edits == 0 for r in got) == 2 and all(r.target != "y y y y" for r in got)
    strata = samples.screen(rows, 20, "s", "sid", F.when(F.col("n_edits") > 0, F.col("n_edits")))
    assert {r.n_edits: r["count"] for r in strata.groupBy("n_edits").count().collect()} == {0: 5, 1: 5, 2: 5, 3: 5}
    first = {r.sid for r in samples.first(rows, "s", "sid", 10).collect()}
    assert first < {r.sid for r in samples.first(rows, "s", "sid", 20).collect()}
    with pytest.raises(RuntimeError, match="too strict"):
        samples.at_least(rows, "s", "sid", 61)


def test_rerank(spark):
    beam = spark.createDataFrame([(1, 0, 0.0, "a b c", "a b c d"), (1, 1, -1.0, "a b d", "a b c d"), (1, 2, -2.0, "a b c", "a b c d")], "sid int, rank int, score double, text string, source string")
    rows = rerank.features(beam).orderBy("candidate").collect()
    assert [(r.edits, r.longer, r.mean_risk, r.identical) for r in rows] == [(1.0, -1.0, 0.5, 1.0), (1.0, -1.0, 1.0, 0.0), (1.0, -1.0, 0.5, 1.0)]
    assert rerank.least_risk(beam).first().picked == 0
    best = spark.createDataFrame([(1, 1)], "sid int, picked int")
    weights = rerank.fit(rerank.labelled(rerank.features(beam), best), 20)
    assert rerank.by_weights(rerank.features(beam), weights).first().picked == 1


def test_several_annotators(spark):
    rows = spark.createDataFrame([(1, 0, 1, 0, 0), (1, 1, 0, 1, 1), (2, 0, 0, 2, 1), (2, 1, 1, 1, 0)], "sid int, annotator int, tp int, fp int, fn int")
    assert kernels.corpus_counts(rows) == (2, 1, 0)
    assert kernels.corpus_counts(rows.where("annotator = 0")) == (1, 2, 1)


def test_complete(spark):
    t = lambda pos, tag, dep, head: _token("x", "x", pos, dep, tag, head)
    rows = spark.createDataFrame([([t("PRON", "PPER", "sb", 1), t("VERB", "VVFIN", "ROOT", 1)],), ([t("SCONJ", "KOUS", "cp", 1), t("VERB", "VVFIN", "ROOT", 1)],), ([t("NOUN", "NN", "ROOT", 0)],), (None,)], f"p array<{injection.TOKEN}>")
    assert [r.c for r in rows.select(clean.is_complete(F.col("p")).alias("c")).collect()] == [True, False, False, False]


def test_vocabulary(spark):
    words = spark.createDataFrame([("<0x0A>", 3), ("a", 4), ("Ġ", 5), ("日", 6), ("ab", 7), ("<s>", 1)], "token string, id int")
    assert {r.token for r in vocabulary.protected(words, [1]).collect()} == {"<0x0A>", "a", "Ġ", "<s>"}
    hist = spark.createDataFrame([("a", 90), ("b", 9), ("c", 1)], "token string, n long")
    keep = spark.createDataFrame([("c",)], "token string")
    assert vocabulary.coverage(hist, (0.9,), keep).first().kept == 2
    mapping = vocabulary.remap(hist, 0.9, keep)
    assert {r.token: r.new_id for r in mapping.collect()} == {"a": 0, "c": 1} and tuple(vocabulary.trim_plan(mapping, 3).first())[:2] == (2, 1)
    pieces = spark.createDataFrame([("abcdefg",)], "w string").select(vocabulary.pieces(F.col("w")).alias("p")).first().p
    assert pieces == ["abc", "def", "g"]
    ids = spark.createDataFrame([(i,) for i in (1, 5, 70_000, 70_001, 900_000)], "v long")
    assert {r.v: r.after for r in vocabulary.with_next(ids, "v").collect()} == {1: 5, 5: 70_000, 70_000: 70_001, 70_001: 900_000, 900_000: None}


def test_text_forms(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "s string").select(c(F.col("s")).alias("x")).first().x
    assert one(text.straight_quotes, 'er sagte " ja " und " nein') == 'er sagte "ja" und " nein'
    assert one(lambda c: text.space_before(F.split(c, " ")), "a ( b ) .") == [False, True, False, False, False]
    assert one(lambda c: prompts.parse_completion(c, F.lit("s")), "Output: ja\nInput: x") == "ja" and one(lambda c: prompts.parse_completion(c, F.lit("s")), " \n") == "s"


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", ""), ("b|c", None)], "k string, v string")
    assert reports.markdown(rows, ["k"]).splitlines()[2:] == ["| a |  |", "| b\\|c |  |"]
    reports.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("emptyValue", "").csv(str(tmp_path / "c")).count() == 2
    with pytest.raises(Exception, match="line feed"):
        reports.write_lines(spark.createDataFrame([("a\nb",)], "l string"), "l", str(tmp_path / "l"))


def test_overlap_predicates(spark):
    gold = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("a-b").alias("correction")))
    make = lambda c: F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(c).alias("correction"))
    row = spark.range(1).select(leniency.matches(gold, make("ab")).alias("a"), leniency.matches(gold, make("ab"), False).alias("b"), edits.is_correct(F.array().cast(f"array<{edits.EDIT}>")).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, True)


def test_encoded_records(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows = spark.createDataFrame([(1, "Input: a", '{"correction": "ab", "changes": []}'), (2, "x " * 2000, "y")], "sid int, prompt string, answer string")
    got = encoding.encoded_records(rows, public_tokenizers.path("byte_bpe_50k.json"), 50256, 0.25).collect()
    assert len(got) == 1 and len(got[0].ids) == len(got[0].labels) == len(got[0].weights) and set(got[0].weights) == {0.0, 0.25, 1.0} and got[0].labels[-1] == 50256
