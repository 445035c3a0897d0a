from pyspark.sql import functions as F

from termloom.functions import text as tx

VECTORS = [
    ("במפקדה ללשכה והמודיעין", "מפקדה לשכה מודיעין"), ("רַע״נ רע''נ רע\"נ", "רענ רענ רענ"), ("תת-אלוף", "תת אלוף"), ("לשכת אלוף", "לשכה אלוף"),
    ("תור למרפאה ובדיקת דם", "תור מרפאה בדיקת דם"), ("8200", "8200"), ("של", "של"), ("בסיס", "בסיס"), ("מבצע", "מבצע"), ("מרפאה", "מרפאה"),
    ("caf\u00e9 x", "caf x"), ("cafe\u0301", "cafe"), ("בדם", "בדם"), ("", ""), (None, None), (" \n\t", ""),
]


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize_text(spark):
    assert column(spark, [v for v, _ in VECTORS], tx.normalize_text) == [n for _, n in VECTORS]


def test_bases_do_not_chain():
    assert tx.chained() == []


def test_token_modes(spark):
    assert column(spark, ["במפקדה", " A-b ", None], lambda c: tx.normalize_token(c, False)) == ["במפקדה", "ab", None]
    assert column(spark, ["במפקדה"], tx.normalize_token) == ["מפקדה"]


def test_raw_tokens(spark):
    assert column(spark, ['רע"נ רע״נ', "a-b c1", "", None], tx.raw_tokens) == [["רע", "נ", "רע״נ"], ["a", "b", "c1"], [], []]


def test_letter_bucket(spark):
    assert column(spark, ["מבצע", "apple", "7x", "םx", "", None, "é"], tx.letter_bucket) == ["מ", "A", "7", tx.OTHER, tx.OTHER, tx.OTHER, tx.OTHER]
    assert len(tx.buckets()) == 22 + 26 + 10 + 1


def test_tokens(spark):
    assert column(spark, ["a b", "", None], tx.tokens) == [["a", "b"], [], []]
