from pyspark.sql import functions as F

from redpen.operators import backtranslation, clean, injection, rerank, scoring, training


def test_funnel_order(spark):
    """A dirty first copy shadows a clean later one; duplicates are told before all else."""
    rows = spark.createDataFrame([(1, 0, "de", "das ist ein Satz mit vielen guten Worten ."), (2, 0, "de", "Das ist ein Satz mit vielen guten Worten."), (3, 0, "de", "Zu kurz."), (4, 0, "de", "Dieser Satz ist zurückgehalten und hat genug viele Worte.")], "doc_id long, pos int, lang string, sentence string")
    held = spark.createDataFrame([("Dieser Satz ist zurückgehalten und hat genug viele Worte .",)], "text string")
    assert {r.doc_id: r.reason for r in clean.funnel(rows, held).collect()} == {1: "unclean", 2: "duplicate", 3: "length", 4: "held out"}


def test_rejections(spark):
    pairs = [
        ("Der Hund bellt laut .", "Der hund belt laut .", 2, None),
        ("Der Hund bellt .", "Der Hund bellt .", 2, "copied when asked for errors"),
        ("Der Hund bellt .", "Der Hund bellt .", 0, None),
        ("Der Hund bellt .", "Der hund bellt .", 0, "asked for none, damaged anyway"),
        ("Der Hund bellt laut im Garten .", "Eine Katze schlief still auf dem Sofa .", 2, "more damaged than real learner German"),
        ("Der Hund bellt .", "Der Hund bellt und bellt und läuft weg .", 1, "length ratio out of range"),
        ("Der Hund bellt bellt bellt bellt .", "Der hund bellt bellt bellt bellt .", 1, "degenerate repetition"),
        ("Der Hund bellt .", "  ", 1, "empty"),
    ]
    rows = spark.createDataFrame([(i, *p[:3]) for i, p in enumerate(pairs)], "i int, correct string, learner string, asked int")
    assert [r.reason for r in backtranslation.rejection(rows, 0.7).orderBy("i").collect()] == [p[3] for p in pairs]


def test_discrete_quantile(spark):
    assert backtranslation.discrete_quantile(spark.range(200).withColumn("v", F.col("id").cast("double")), "v", 0.99).first().threshold == 198.0


def test_span_scores(spark):
    edit = "sid int, start int, end int, correction string, error_type string, ordinal int"
    gold = spark.createDataFrame([(1, 2, 3, "die", "R:DET:FORM", 0), (1, 1, 2, "sah", "R:VERB:FORM", 1)], edit)
    system = spark.createDataFrame([(1, 2, 3, "die", "R:DET", 0), (1, 1, 2, "falsch", "R:ADJ", 1)], edit)
    got = {r.error_type: (r.tp, r.fp, r.fn) for r in scoring.counts_by_type(scoring.span_join(gold, system)).collect()}
    assert got == {"R:DET:FORM": (1, 0, 0), "R:ADJ": (0, 1, 0), "R:VERB:FORM": (0, 0, 1)}
    found = scoring.counts_by_type(scoring.span_join(gold, system, "detection")).agg(F.sum("tp").alias("tp")).first()
    assert found.tp == 2


def test_moves(spark):
    rows = spark.createDataFrame([(1, 0, "U:VERB", "gratulieren"), (1, 1, "M:VERB", "gratulieren"), (1, 2, "M:DET", "der")], "sid int, ordinal int, error_type string, words string")
    assert [r.moved for r in scoring.mark_moves(rows).orderBy("ordinal").collect()] == [True, True, False]


def test_injection_fixtures(spark):
    """Rules that the driver's prose never fires."""
    found = lambda s, lang: {(c.rule, c.start, c.correction) for c in spark.range(1).select(injection.candidates(F.split(F.lit(s), " "), lang).alias("c")).first().c}
    assert ("drop_inverted_punctuation", 0, "") in found("¿ Qué es ?", "es")
    got = found("Das Straße , für", "de")
    assert {("das_dass", 0, "Dass"), ("sharp_s", 1, "Strasse"), ("drop_comma", 2, ""), ("preposition", 3, "um"), ("article_form", 0, "Der")} <= got


def test_rerank(spark):
    beam = spark.createDataFrame([(1, 0, 0.0, 0, 1, 2, "a"), (1, 1, -0.1, 2, 0, 2, "b"), (2, 0, 0.0, 1, 0, 1, "c"), (2, 1, -0.1, 1, 0, 1, "d")], "sid int, rank int, score double, tp int, fp int, distance int, text string")
    assert {r.sid: r.picked for r in rerank.oracle(beam).collect()} == {1: 1, 2: 0}
    assert [tuple(r) for r in rerank.preference_pairs(beam).collect()] == [(1, 1, 3)]


def test_answers(spark):
    change = F.array(F.struct(F.lit("a").alias("was"), F.lit('b"').alias("now"), F.lit("R").alias("type")))
    text = training.build_answer(F.lit('x "y"'), change)
    row = spark.range(1).select(text.alias("t"), training.parse_answer(text).alias("p"), training.parse_answer(F.lit('{"correction": "cut off", "chan')).alias("q"), training.parse_answer(F.lit("no")).alias("n")).first()
    assert row.t == '{"correction": "x \\"y\\"", "changes": [{"was": "a", "now": "b\\"", "type": "R"}]}'
    assert row.p.complete and row.p.correction == 'x "y"' and row.p.changes[0].now == 'b"'
    assert row.q.correction == "cut off" and not row.q.complete and row.n is None


def test_checker_matches(spark):
    matches = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(n).alias("length"), F.lit(r).alias("replacement")) for o, n, r in ((4, 5, "weiß"), (4, 9, "weiß, dass"))])
    assert spark.range(1).select(training.apply_matches(F.lit("Ich weiss das ."), matches).alias("x")).first().x == "Ich weiß das ."


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
