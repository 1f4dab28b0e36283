"""Steps whose work may grow with the input alone: long sentences, within a time that the
form before took many times over."""

import difflib
import random
import time

from pyspark.sql import functions as F

from redpen.functions import edits
from redpen.operators import backtranslation, checker, encoding, explanations, injection, kernels, leniency, rerank, scoring
from redpen.plans import corrections, evaluation


def _documents(spark, path, *texts):
    rows = spark.createDataFrame([(i, t, "de", "x", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{path}/documents.parquet")
    return str(path)


def _seconds(run):
    began = time.perf_counter()
    return run(), time.perf_counter() - began


def test_checker_matches_of_a_long_line(spark, tmp_path):
    """Spans are found once for a line, not once for each of its edits."""
    path = _documents(spark, tmp_path, " ".join(f"wort{i % 97}" for i in range(10_000)))
    got, seconds = _seconds(lambda: {r.error_type: r.injected for r in evaluation.checker_matches(spark, path).collect()})
    assert got == {"R:A": 556, "R:B": 556} and seconds < 20


def test_spans_of_many_tokens(spark):
    words = ["é" * (i % 5) + "a" for i in range(331)]
    for n in (0, 1, 63, 64, 65, 128, 331):
        at, expected = 0, []
        for w in words[:n]:
            expected.append((at, at + len(w)))
            at += len(w) + 1
        assert [tuple(x) for x in spark.createDataFrame([(words[:n],)], "w array<string>").select(edits.token_spans(F.col("w")).alias("s")).first().s] == expected


def test_matches_meet_windows_across_blocks(spark):
    windowed = spark.createDataFrame([(1, 0, "A", 250, 258), (1, 1, "B", 257, 900), (1, 2, "C", None, None), (2, 0, "A", 0, 2000)], "sid int, ordinal int, error_type string, low int, high int")
    matches = spark.createDataFrame([(1, 0, 250, 8, "x"), (1, 1, 100, 700, "x"), (1, 2, 5000, 8, "x"), (1, 3, 255, 0, "x"), (2, 0, 1999, 8, "y")], "sid int, match int, offset int, length int, rule_id string")
    assert {tuple(r) for r in checker.attributed(matches, windowed).collect()} == {(1, 0, 0, "A", "x"), (1, 1, 1, "B", "x"), (2, 0, 0, "A", "y")}


def test_distance_of_long_sequences():
    """A column of the table in the bits of a number, and lengths alone where tokens are only left out."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(1)) % 3000}" for _ in range(24_000)]
    less, other = (["x", *(w for i, w in enumerate(words) if (i + 1) % k)] for k in (4, 5))
    left, seconds = _seconds(lambda: kernels.token_distance(words, less[1:]))
    assert left == 6000 and seconds < 0.5
    got, seconds = _seconds(lambda: kernels.token_distance(less, other))
    assert len(other) - len(less) <= got <= 10_800 and seconds < 2
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in range(2))
        assert kernels.token_distance(a, b) == kernels._by_rows(list(a), list(b), 1)


def test_distance_is_found_once(spark, tmp_path, capsys):
    path = _documents(spark, tmp_path, "eins zwei drei vier fünf sechs sieben acht")
    corrections.divergence_threshold(spark, path).explain()
    assert capsys.readouterr().out.count("+- ArrowEvalPython") == 1


def test_repeats_of_a_long_text(spark):
    """The words are found once, not at each place."""
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(6000)) + tail,) for tail in ("", " a a a a")], "t string")
    got, seconds = _seconds(lambda: [r.x for r in rows.select(backtranslation.repeats(F.array_remove(F.split("t", " +"), "")).alias("x")).collect()])
    assert got == [False, True] and seconds < 5


def test_stretches_are_those_of_matching_blocks():
    rng = random.Random(7)
    slow = lambda a, b: sum(o[0] != "equal" for o in difflib.SequenceMatcher(None, a, b).get_opcodes())
    for k in range(600):
        names = [str(i) for i in range(rng.choice((2, 5, 30, 200)))]
        a = [names[min(int(rng.paretovariate(0.7)) - 1, len(names) - 1)] for _ in range(rng.choice((6, 30, 300)))]
        b = [w for w in a if rng.random() < 0.75] if k % 2 else [rng.choice(names) for _ in range(rng.choice((0, 6, 30, 300)))]
        assert kernels.differing(a, b + a[:4]) == slow(a, b + a[:4])


def test_features_deal_lists_out_once(spark):
    """Every pair of a list was joined and all texts were dealt out five times (F2)."""
    beam = spark.createDataFrame([(1, 0, -0.5, "a b c", "a b c"), (1, 1, 0.0, "a c", "a b c"), (1, 2, -1.0, "a  c", "a b c"), (2, 0, None, "x", "y"), (None, 0, 0.0, "x", "x")], "sid int, rank int, score double, text string, source string").repartition(3)
    rows = rerank.features(beam)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {tuple(r)[:2]: tuple(r)[2:] for r in rows.collect()}
    assert got[1, 0] == (-0.5, -0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    assert got[1, 1] == (0.0, 0.0, 1.0, 1.0, 1 / 3, -1.0, 1.0, 0.5, 0.0)
    assert got[2, 0] == (None, None, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0) and len(got) == 4
    assert {tuple(r) for r in rerank.distances(beam.select("sid", "rank", "text")).select("sid", "rank", "risk", "identical").collect()} == {(1, 0, 2, 0), (1, 1, 1, 0), (1, 2, 1, 0), (2, 0, 0, 0)}


def test_maxmatch_of_deletions(monkeypatch):
    """Places where an alignment has a choice are judged by themselves, long ones row by row."""
    source = ["Die"] * 4000 + [f"w{i}" for i in range(6000)]
    hyp = [w for i, w in enumerate(source) if i % 7]
    got, seconds = _seconds(lambda: kernels.maxmatch_counts(source, hyp, [(i, i + 1, "") for i in range(0, 10_000, 14)]))
    assert got[0] + got[2] == 715 and got[0] >= 429 + 286 - 1 and seconds < 10

    def slow(source, hyp, gold):
        keys = set(gold)
        found = kernels.maxmatch_edits(source, hyp, keys)
        tp = sum(e in keys for e in found)
        return tp, len(found) - tp, len(keys) - tp

    rng = random.Random(11)
    for short in (32, 0):
        monkeypatch.setattr(kernels, "_SHORT", short)
        for _ in range(150):
            source = [rng.choice("abcdefghij"[: rng.choice((1, 2, 4, 10))]) for _ in range(rng.choice((3, 14, 26)))]
            share = rng.choice((0.1, 0.3, 0.8))
            hyp = [w for w in source if rng.random() > share]
            gold = [(i, i + k, " ".join(w for w in source[i : i + k] if rng.random() < 0.5)) for i in range(len(source)) for k in (1, 3) if rng.random() < 0.3]
            assert kernels.maxmatch_counts(source, hyp, gold) == slow(source, hyp, gold)


def test_edits_of_a_long_document(spark, tmp_path):
    """A document's edits come from its own tokens and are put in once."""
    words = [f"w{i}" for i in range(60_000)]
    path = _documents(spark, tmp_path, " ".join(words), "", "a")
    plan = corrections.apply_edits(spark, path)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    got, seconds = _seconds(lambda: {r.sid: r.n_tokens for r in plan.collect()})
    expected = sum(1 if i % 11 == 0 else 0 if i % 13 == 0 else 2 if i % 17 == 0 else 1 for i in range(60_000))
    assert got == {0: expected, 1: 0, 2: 1} and seconds < 10
    got, seconds = _seconds(lambda: evaluation.reversed_pairs(spark, path).collect())
    assert [r["count"] for r in got] == [sum(i % 11 == 0 or i % 13 == 0 or i % 17 == 0 for i in range(60_000))] and seconds < 10


def test_skipped_edits_and_order(spark):
    own = [(3, 3, "z", 0), (1, 2, "", 0), (0, 2, "x y", 0), (-1, -1, "", 0)]
    rows = spark.createDataFrame([(list("abcd"), own), (list("abcd"), []), ([], [])], "w array<string>, e array<struct<start:int,end:int,correction:string,annotator:int>>")
    ordered = edits.edits_for(F.col("e"))
    got = rows.select(F.transform(ordered, lambda e: e["start"]).alias("o"), F.array_join(edits.apply(F.col("w"), ordered, strict=False), " ").alias("t")).collect()
    assert [(r.o, r.t) for r in got] == [([0, 1, 3], "x y c z d"), ([], "a b c d"), ([], "")]


def test_moves_are_one_sum(spark):
    """Deletions and insertions are read once, not once each."""
    rows = spark.createDataFrame([(1, 0, "U:A", "x"), (1, 1, "M:A", "x"), (1, 2, "M:A", "x"), (1, 3, "M:B", "x"), (1, 4, "UNK", "x")], "sid int, ordinal int, error_type string, words string")
    moved = scoring.mark_moves(rows)
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r.ordinal: r.moved for r in moved.collect()} == {0: True, 1: False, 2: True, 3: False, 4: False}


def test_risk_of_long_lists_of_edits(spark):
    """Edits are hashed, not compared with each other."""
    edit = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct(i.alias("start"), (i + 1).alias("end"), F.lit("x").alias("correction")))
    beam = spark.range(3).select(F.lit(1).alias("sid"), F.col("id").cast("int").alias("rank"), F.filter(edit, lambda e: e["start"] % 3 >= F.col("id")).alias("edits"))
    got, seconds = _seconds(lambda: [tuple(r) for r in rerank.minimum_risk(beam).collect()])
    assert got == [(1, 1, 13_334)] and seconds < 10


def test_claims_about_a_word_that_stands_everywhere(spark):
    """Only the places near an edit are looked at."""
    claims = "array<struct<was:string,now:string,type:string>>"
    made = "array<struct<start:int,end:int,error_type:string,correction:string>>"
    own = [(i, i + 1, "R", f"x{i}") for i in range(0, 4000, 40)] + [(3999, 3999, "M", "y")]
    rows = spark.createDataFrame([(["Die"] * 4000, own, [("Die", f"x{i}", "R") for i in range(0, 4000, 80)] + [("Die Die", "y", ""), ("Das", "y", "R")])], f"w array<string>, e {made}, c {claims}")
    got, seconds = _seconds(lambda: tuple(rows.select(explanations.explained(F.col("w"), F.col("e"), F.col("c")).alias("x")).first().x))
    assert got == (101, 52, 51, 51, 50, 51) and seconds < 10


def _german(spark, n):
    words = [f"Wort{i}" if i % 3 else "und" for i in range(n)]
    parse = [(w, w, "X", "KON" if w == "und" else "VVFIN" if i % 3 == 1 else "NN", "ROOT", i, {}) for i, w in enumerate(words)]
    return spark.createDataFrame([(1, words, parse)], f"sid int, w array<string>, p array<{injection.TOKEN}>")


def test_rules_over_a_long_sentence(spark):
    """Dependants and the last finite verb are found once, not at each place (F16)."""
    found = lambda n: [c for c in _german(spark, n).select(injection.candidates(F.col("w"), "de", F.col("p")).alias("c")).first().c if c.rule.startswith("comma")]
    assert [(c.rule, c.start) for c in found(10)] == [("comma_after_fronted", 1), ("comma_after_fronted", 4), ("comma_after_fronted", 7), ("comma_before_und", 9)]
    got, seconds = _seconds(lambda: found(12_000))
    assert len(got) == 4000 and seconds < 15


def test_candidates_are_found_once(spark, tmp_path):
    """A filter below the explode found the candidates twice more."""
    path = _documents(spark, tmp_path, "der Hund läuft über die Straße")
    assert corrections.injection_choice(spark, path)._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 2


def test_candidates_that_ask_nothing_are_dealt_out(spark):
    """Null keys all met in one task."""
    rows = spark.range(60).select(F.col("id").alias("sid"), F.array(F.lit("por"), F.lit("casa"), F.lit("x1")).alias("tokens")).repartition(3)
    known = spark.createDataFrame([("cssa",), (" 1 0",), ("cqsa",)], "word string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = injection.with_dictionary(rows, known, lang="es")
        dealt = {r.p: r["count"] for r in out.where("rule = 'preposition'").groupBy(F.spark_partition_id().alias("p")).count().collect()}
        assert sum(dealt.values()) == 60 and max(dealt.values()) < 45
        assert out.where("rule = 'preposition' and correction = 'para'").count() == 60
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_records_are_encoded_in_slices(spark, monkeypatch):
    """A batch's encodings, and its texts, were held all at once."""
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    held = tokenizers.Tokenizer.from_file(path)
    texts = ['{"correction": "Grüße 😀 an", "changes": []}', "no marker", 'x, "changes": [é]', "a" * 5000, ""]
    for t in texts:
        a = held.encode(t, add_special_tokens=False)
        split = t.find(encoding.MARKER)
        assert encoding._late(a, split) == (sum(s < split for s, _ in a.offsets) if split >= 0 else len(a.ids))
    rows = spark.createDataFrame([(i, "p q", texts[i % 5]) for i in range(600)], "sid int, prompt string, answer string").coalesce(1)
    got = {r.sid: r for r in encoding.encoded_records(rows, path, 9, 0.25, longest=600).collect()}
    for i in range(600):
        p, a = held.encode("p q"), held.encode(texts[i % 5], add_special_tokens=False)
        split = texts[i % 5].find(encoding.MARKER)
        expected = encoding.encode(p.ids, a.ids, [(s, s + 1) for s, _ in a.offsets], 9, split if split >= 0 else None, 0.25, 600)
        assert (expected is None and i not in got) or (got[i].ids, got[i].labels, got[i].weights) == expected
    composed = spark.createDataFrame([("é" * (i % 3) if i % 7 else None,) for i in range(700)], "t string").coalesce(1).select(kernels.nfc("t").alias("t")).collect()
    assert [r.t for r in composed] == ["é" * (i % 3) if i % 7 else None for i in range(700)]
    assert encoding._ROWS <= 1024


def test_lenient_pairs_meet_by_span(spark):
    """The edits of a span are dealt out once (F15), with the rows of the joins that synonyms take."""
    rng = random.Random(3)
    texts = ["air-bag", "Airbag", "airbag", "air–bag", "x", "X", "“x”", '"x"', "é", "é", None, ""]
    kind = "sid int, start int, end int, correction string, error_type string, ordinal int"
    make = lambda: spark.createDataFrame([(rng.choice((1, 2, 3, None)), s := rng.randint(0, 3), s + 1, rng.choice(texts), rng.choice("AB"), i) for i in range(80)], kind)
    gold, system = make(), make()
    got = leniency.lenient_join(gold, system)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    parsed = lambda d: d.withColumn("parse", F.array().cast(f"array<{injection.TOKEN}>"))
    expected = leniency.lenient_join(parsed(gold), parsed(system), synonyms=spark.createDataFrame([], "word string, synonym string"))
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(got) == key(expected)
