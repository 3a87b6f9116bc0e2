import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import judging, populations


def test_language_names():
    assert [populations.language_name(x) for x in ("Hindi Devanagari", "Indian English", "Tamil", "English", "", None)] == ["Hindi", "English", "Tamil", "English", None, None]
    labels = {"hi_Deva_IN": "Hindi Devanagari", "en_IN": "Indian English", "ta_IN": "Tamil"}
    of = lambda c, corpus: populations.language_filter(c, corpus, labels=labels)
    assert of("en_IN", "hi_Latn_IN") == ("first_language", "Angrezi") and of("hi_Deva_IN", "hi_Deva_IN") == ("first_language", "हिंदी")
    assert of("ta_IN", "en_IN") == ("first_language", "Tamil") and of("ta_IN", "de_DE") is None and of("xx", "en_IN") is None


def test_populations(spark):
    people = spark.createDataFrame([("Hindi",), ("Hindi",), ("Tamil",), (None,)], "first_language string")
    labels = {"a": "Hindi Latin", "b": "Tamil", "c": "Odia", "d": ""}
    got = {r.conversation_locale: (r.language, r.eligible_rows, r.total_rows, r.eligible_percent) for r in populations.language_populations(people, ["a", "b", "c", "d", "a"], "en_IN", labels=labels).collect()}
    assert got == {"a": ("Hindi", 2, 4, 50.0), "b": ("Tamil", 1, 4, 25.0), "c": ("Odia", 0, 4, 0.0)}
    none = populations.language_populations(people.limit(0), ["a"], "en_IN", labels=labels).collect()
    assert [(r.eligible_rows, r.total_rows, r.eligible_percent) for r in none] == [(0, 0, 0.0)]
    assert populations.language_populations(people, ["d"], "en_IN", labels=labels).collect() == []
    assert populations.matching_personas(people, "b", "en_IN", labels=labels).count() == 1 and populations.matching_personas(people, "b", "de_DE", labels=labels).count() == 4
    panel = spark.createDataFrame([("x",), ("x",), (None,)], "locale string")
    assert [tuple(r) for r in populations.panel_locales(panel).collect()] == [("x", 2)]


def test_visible_tokens(spark):
    messages = [
        {"role": "user", "content": "one two three"}, {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "find", "arguments": "{}"}}]}, {"role": "tool", "content": "found it"},
        {"role": "assistant", "content": "here you are", "tool_calls": []}, {"role": "assistant"},
    ]
    df = spark.createDataFrame([(json.dumps(messages),), ("broken",), (None,), ("[]",)], "conversation_messages string")
    text = df.select(*[populations.visible_text(F.col("conversation_messages"), a).alias(a) for a in populations.ALIAS_ROLES]).collect()
    assert text[0].assistant_model == '\n[{"function":{"name":"find","arguments":"{}"}}]\nhere you are\n' and text[0].user_model == "one two three" and text[0].api_response_model == "found it"
    assert text[1].user_model is None and text[2].user_model is None and text[3].assistant_model == ""
    got = {r.alias: (r.n_rows, r.n_unreadable, r.visible_tokens) for r in populations.visible_tokens(df).collect()}
    assert got == {"assistant_model": (4, 2, 6), "user_model": (4, 2, 4), "api_response_model": (4, 2, 3)}
    chars = {r.alias: r.visible_tokens for r in populations.visible_tokens(df, count=F.length).collect()}
    assert chars["api_response_model"] == 8


def test_item_reasons(spark):
    rows = [
        ("a", 0, "f1", {"acc": (5.0, "fine"), "fab": (None, "x")}), ("a", 1, "f2", {"acc": (2.0, "")}), ("a", 2, "f3", {"acc": (3.0, "half")}), ("a", 3, None, {"acc": (3.0, "also")}),
        ("b", 0, "g", {"acc": (4.0, "good"), "fab": (2.5, None)}), ("c", 0, None, {"acc": (4.0, ""), "fab": (float("nan"), "n")}),
    ]
    df = spark.createDataFrame(rows, "k string, position int, item_id string, scores map<string,struct<score:double,reasoning:string>>")
    got = {(r.k, r.axis): (r.n, r.score, r.reasoning) for r in judging.item_reasons(df, "k", ["acc", "fab"]).collect()}
    assert got == {
        ("a", "acc"): (4, 3.25, 'Mean 3.25 across 4 facts. Lowest scoring:\n• "f3" (score=3): half\n• "?" (score=3): also'),
        ("a", "fab"): (0, None, "no per-fact scores"),
        ("b", "acc"): (1, 4.0, "[g] good"),
        ("b", "fab"): (1, 2.5, "score=2.5 on fact 'g'"),
        ("c", "acc"): (1, 4.0, "score=4"),
        ("c", "fab"): (0, None, "no per-fact scores"),
    }
    dull = df.withColumn("scores", F.transform_values("scores", lambda _, v: F.struct(v["score"].alias("score"), F.lit("").alias("reasoning"))))
    assert {r.reasoning for r in judging.item_reasons(dull, "k", ["acc"], unit=("category", "categories")).where("k = 'a'").collect()} == {"Mean 3.25 across 4 categories."}


@pytest.mark.parametrize("corpus", ["en_IN", "hi_Deva_IN"])
def test_shipped_labels(corpus):
    assert populations.language_filter("hi_Deva_IN", corpus) == ("first_language", {"en_IN": "Hindi", "hi_Deva_IN": "हिंदी"}[corpus])
