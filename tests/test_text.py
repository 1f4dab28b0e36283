import pytest
from pyspark.sql import functions as F

from redpen.functions import text


def _one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], [*names]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("sentence", "clean"),
    [
        ("Das ist gut.", True),
        ("das ist gut.", False),
        ("Das ist gut", False),
        ("Siehe http://x.de.", False),
        ("DAS IST GUT.", False),
        ("Er sagte „ja“.", True),
        ("Er sagte „ja.", False),
        ("5 Hunde bellen!", True),
        ("Привет мир.", True),
        ("Das ~ hier.", False),
        ("", False),
    ],
)
def test_is_clean(spark, sentence, clean):
    assert _one(spark, text.is_clean(F.col("s"), "de"), s=sentence) is clean


def test_tokens_and_keys(spark):
    assert _one(spark, text.tokens(F.col("s")), s=" a b  c\x1cd ") == ["a", "b", "c", "d"]
    assert _one(spark, text.normalise(F.col("s")), s="Das Jahr .") == "dasjahr."
    assert _one(spark, text.unstressed(F.col("s")), s="Áñü") == "añü"
    assert _one(spark, text.typographic(F.col("s")), s="„a“ – b") == '"a" - b'
    assert _one(spark, text.tokenize(F.col("s")), s="Ja, gut.") == "Ja , gut ."
    assert _one(spark, text.detokenize(F.col("s")), s="Ja , gut .") == "Ja, gut."


@pytest.mark.parametrize(("a", "b", "same"), [("Haus-Tür", "haustür", True), ("Haustür", "haustür", False), ("a-b", "a b", False), ("a-b", "ac", False)])
def test_same_compound(spark, a, b, same):
    assert _one(spark, text.same_compound(F.col("a"), F.col("b")), a=a, b=b) is same
