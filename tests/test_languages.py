import pytest
from pyspark.sql import functions as F

from larkspur.functions import languages


@pytest.mark.parametrize(
    "text, language, script, foreign",
    [
        ("the cat is on the mat", "en", "Latin", []),
        ("der Hund ist nicht im Haus", "de", "Latin", []),
        ("это текст and one", "ru", "Cyrillic", ["Cyrillic"]),
        ("한국어 문장입니다", "ko", "Hangul", ["Hangul"]),
        ("12 !", None, None, []),
        ("xyzzy", None, "Latin", []),
    ],
)
def test_languages(spark, text, language, script, foreign):
    df = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    row = df.select(languages.detect_language(t).alias("l"), languages.dominant_script(t).alias("s"), languages.foreign_scripts(t, F.array(F.lit("Latin"))).alias("f")).first()
    assert (row.l, row.s, row.f) == (language, script, foreign)


def test_detection_on_labelled_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400")
    got = d.select((F.col("lang") == languages.detect_language(F.col("text"))).cast("int").alias("ok")).agg(F.avg("ok").alias("a")).first().a
    assert got > 0.9


def test_match_rates(spark):
    df = spark.createDataFrame([(["the cat is here", "und das ist nicht"],), ([],)], "t array<string>")
    rates = languages.language_match_rates(F.col("t"), F.lit("en"))
    got = df.select(*[c.alias(n.split(".")[1]) for n, c in rates.items()]).collect()
    assert [tuple(r) for r in got] == [(0.5, 1.0), (None, None)]


def test_codes_do_not_count(spark):
    df = spark.createDataFrame([("मेरा कोड AB12 है",), ("AB12",)], "t string")
    got = [r.v for r in df.select(languages.user_script_compliance(F.col("t"), "Devanagari").alias("v")).collect()]
    assert got == [1.0, None] or got[0] > 0.5


@pytest.mark.parametrize("text, script, language", [("Ωμέγα and Alpha \u00aa", "Latin", "en"), ("Straße ÀĀẠ — Ωμ", "Latin", None), ("東京タワービル", "Katakana", "ja"), (None, None, None), ("— 12 ×", None, None), ("the ქართული", "Latin", "en")])
def test_scripts_of_mixed_texts(spark, text, script, language):
    row = spark.createDataFrame([(text,)], "t string").select(languages.dominant_script(F.col("t")).alias("s"), languages.detect_language(F.col("t")).alias("l")).first()
    assert (row.s, row.l) == (script, language)


def test_letters_are_counted_without_a_value_each(spark):
    """letters used to be extracted one by one for every script; what isn't Latin is now taken out once for all of them."""
    df = spark.createDataFrame([("a",)], "t string").select(languages.dominant_script(F.col("t")))
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_split_once(spark):
    """F8: texts used to be split anew for every language."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(languages.detect_language(F.col("text")).alias("l"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(lower(") == 1
