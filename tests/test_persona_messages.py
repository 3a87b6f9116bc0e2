import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import locales, messages, persona


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [('{"t_score": 57}', 37 / 60), ('{"label": "x"}', 0.5), ("0.7", 0.7), ("9", 1.0), ("x", 0.5), (None, 0.5), ('{"t_score": 0}', 0.0)])
def test_traits(spark, raw, want):
    assert one(spark, persona.ocean(F.col("t")), t=raw) == pytest.approx(want)


def test_behaviour(spark):
    traits = {t: F.lit(0.9 if t == "neuroticism" else 0.2) for t in persona.TRAITS}
    b = persona.behaviour(traits, F.lit("no_formal"), F.lit("farm hand"), F.lit("80"))
    got = {k: one(spark, v) for k, v in b.items()}
    assert got == pytest.approx({"patience": 0.29, "verbosity": 0.41, "cooperativeness": 0.42, "tech_literacy": 0.05, "error_proneness": 0.8})


@pytest.mark.parametrize("a, n, p, want", [(0.4, 0.7, 0.3, "confrontational"), (0.5, 0.55, 0.4, "frustrated"), (0.5, 0.2, 0.3, "impatient"), (0.7, 0.3, 0.6, "cooperative"), (0.5, 0.5, 0.5, "neutral")])
def test_styles(spark, a, n, p, want):
    assert one(spark, persona.interaction_style(F.lit(a), F.lit(n), F.lit(p))) == want


@pytest.mark.parametrize("style, turn, failures, patience, want", [("confrontational", 0, 0, 0.9, 2), ("frustrated", 2, 2, 0.4, 3), ("neutral", 2, 0, 0.4, 1), ("cooperative", 1, 1, 0.9, 0), ("unheard of", 0, 3, 0.9, 3)])
def test_frustration(spark, style, turn, failures, patience, want):
    assert one(spark, persona.frustration_level(F.lit(style), F.lit(turn), F.lit(failures), F.lit(patience))) == want


def test_tags(spark):
    got = one(spark, persona.persona_tags(F.col("a"), F.col("e"), F.col("o"), F.lit("South")), a="30", e="Masters degree", o="Software engineer")
    assert got == sorted({*persona.BROAD_TAGS, "age:25-44", "education:tertiary", "occupation-family:engineering", "interest:geography", "region:south"})
    for job, family in (("Krankenpflegerin", "healthcare"), ("Leitung Pflege", "healthcare"), ("Baumpfleger", None), ("dona de casa", "homemaker"), ("Enfermeira", "healthcare"), ("art teacher", "teacher")):
        assert [x for x in one(spark, persona.persona_tags(F.lit("30"), F.lit(None).cast("string"), F.col("o")), o=job) if x.startswith("occ")] == ([f"occupation-family:{family}"] if family else [])
    assert one(spark, persona.persona_tags(F.col("a"), F.col("a"), F.col("a")), a=None) == sorted(persona.BROAD_TAGS)


def test_texts(spark):
    assert one(spark, persona.persona_text(name=F.lit("Ann"), job_title=F.lit(" "), age=F.lit(3))) == "name: Ann\nage: 3"
    assert one(spark, persona.location_text(F.lit("Rome"), F.lit(None), F.lit("Rome"), F.lit("Italy"))) == "Rome, Italy"


@pytest.mark.parametrize("text, limit, want", [("abc", 3, "abc"), ("abcd", 3, "abc [cut: 3 of 4 characters shown]"), ("a漢b", 4, "a漢 [cut: 2 of 3 characters shown]"), ("漢", 2, " [cut: 0 of 1 characters shown]")])
def test_cut(spark, text, limit, want):
    assert one(spark, messages.cut_tool_result(F.col("t"), limit), t=text) == want


@pytest.fixture(scope="module")
def dialogue(spark):
    calls = json.dumps([{"function": {"name": "look", "arguments": "{}"}}])
    m = [("system", "s", None), ("user", "hi", None), ("assistant", "", calls), ("tool", "x" * 9, None), ("assistant", "done", None), ("assistant", None, None)]
    return spark.createDataFrame([(m,), ([],)], "m array<struct<role:string,content:string,tool_calls:string>>")


def test_render(dialogue):
    got = [r.v for r in dialogue.select(messages.render(F.col("m"), 4).alias("v")).collect()]
    assert got == ["User: hi\nAssistant [tool calls]: look({})\nTool response: xxxx [cut: 4 of 9 characters shown]\nAssistant: done", "N/A"]


def test_public(dialogue):
    got = dialogue.select(messages.public_messages(F.col("m")).alias("v")).first().v
    assert [(m.role, m.content) for m in got] == [("user", "hi"), ("assistant", "(after using its tools) done")]


@pytest.mark.parametrize("raw, want", [(None, ("general", "General conversation")), ("[]", ("general", "General conversation")), ('[{"type":"a","description":"b"}]', ("a", "b")), ('{"type":"a"}', ("a", None)), ("sport", ("sport", "sport"))])
def test_theme(spark, raw, want):
    assert tuple(one(spark, messages.theme(F.col("t")), t=raw)) == want


@pytest.mark.parametrize("raw, want", [('so: ```{"a": 1}``` ok', {"a": "1"}), ("none", {}), (None, {}), ("[1]", {}), ("{broken", {})])
def test_object_in_text(spark, raw, want):
    assert one(spark, messages.object_in_text(F.col("t")), t=raw) == want


TOOLS = json.dumps([{"tool": {"function": {"name": "f", "parameters": {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "string", "enum": ["x"]}, "c": {"type": "array", "items": {"type": "number"}}}}}}}])


@pytest.mark.parametrize(
    "name, raw, fine",
    [("f", '{"a": 1}', True), ("f", "{}", False), ("g", "{}", False), ("f", '{"a": "1"}', False), ("f", '{"a": 1, "b": "y"}', False), ("f", '{"a": 1, "c": [1, 2.5]}', True), ("f", '{"a": 1, "c": ["q"]}', False), ("f", '{"a": 1, "z": 1}', False), ("f", "oops", False), (None, "{}", False), ("f", "[1]", False)],
)
def test_calls(spark, name, raw, fine):
    df = spark.createDataFrame([(name, raw, TOOLS)], "n string, r string, t string")
    got = df.select(messages.verify_call(F.col("n"), F.col("r"), F.col("t")).alias("v")).first().v
    assert (got is None) is fine


def test_judge_reply(spark):
    assert tuple(one(spark, messages.judge_reply(F.col("t")), t='{"explanation": "good", "rating": 4}')) == ("good", 4.0)
    assert tuple(one(spark, messages.judge_reply(F.col("t")), t="no idea")) == (None, None)


@pytest.mark.parametrize("code, value, want", [("en_US", 1234567.5, "$1,234,567.50"), ("de_DE", -1234.5, "-1.234,50 €"), ("en_IN", 12345678.0, "₹1,23,45,678.00"), ("ja_JP", 5.0, "¥5.00"), ("en_IN", 999.0, "₹999.00")])
def test_money(spark, code, value, want):
    assert one(spark, locales.money(F.col("v"), code), v=value) == want


def test_locales(spark):
    assert [locales.resolve(x) for x in ("en_US", "de_AT", "xx", None)] == ["en_US", "de_DE", "en_US", "en_US"]
    assert one(spark, locales.percent(F.col("v"), "fr_FR"), v=12.34) == "12,3 %"


def test_cut_weighs_only_what_can_be_shown(spark):
    """every character of a text used to be weighed one by one, however long it was."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(messages.cut_tool_result(F.col("text"), 10))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(substring(" in plan and "split(text" not in plan
    texts = ["漢" * 2 + "a" * 30, "a" * 9 + "漢" + "b" * 20, "😀" * 12, "a" * 10 + "漢"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(messages.cut_tool_result(F.col("t"), 10).alias("c")).collect()
    assert [r.c.split(" [cut: ")[0] for r in got] == [texts[0][:6], texts[1][:9], texts[2][:10], texts[3][:10]]
