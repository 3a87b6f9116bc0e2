import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import finance


@pytest.mark.parametrize(
    "education, occupation, want",
    [("masters", "nurse", "high"), ("high school", "tax adviser", "high"), ("high school", "nurse", "medium"), ("illiterate", "farmer", "low"), ("illiterate", "Investor", "medium"), (None, None, "medium")],
)
def test_literacy(spark, education, occupation, want):
    df = spark.createDataFrame([(education, occupation)], "e string, o string")
    assert df.select(finance.literacy(F.col("e"), F.col("o")).alias("x")).first().x == want


def test_tags_and_weights(spark):
    df = spark.createDataFrame([("24", " New York ", "School Teacher", "low"), ("x", None, "", "high"), ("70", "a", "Banker", "medium"), ("40", None, None, "medium")], "a string, r string, o string, l string")
    got = df.select(finance.customer_tags(F.col("a"), F.col("r"), F.col("o"), F.col("l")).alias("t"), finance.type_weights(F.col("a"), F.col("o"), F.col("l")).alias("w")).collect()
    assert got[0].t == ["age:18-24", "region:new_york", "occupation-family:school_teacher", "financial-literacy:low"] and got[1].t == ["financial-literacy:high"] and got[2].t[0] == "age:65+"
    assert [r.w for r in got] == [
        {"bank": 1.5, "brokerage": 1.5, "retirement_provider": 1.0, "wealth_manager": 1.0}, {"bank": 1.0, "brokerage": 2.0, "retirement_provider": 1.0, "wealth_manager": 2.0},
        {"bank": 1.0, "brokerage": 2.0, "retirement_provider": 2.5, "wealth_manager": 2.75}, {"bank": 1.0, "brokerage": 1.0, "retirement_provider": 1.5, "wealth_manager": 1.0},
    ]


def frames(spark):
    people = spark.createDataFrame([(f"p{k}", str(20 + k % 60), "north" if k % 3 else None, ["nurse", "trader", None][k % 3], ["masters", "illiterate", ""][k % 3]) for k in range(200)], "persona_uuid string, age string, region string, occupation string, education_level string")
    space = {"card": ["a", 'b"q'], "none": []}
    template = lambda i, kind, t, tier, tags: (i, kind, t, tier, tags, ["Block {{card}} please", "My {{card}} and {{other}}"], space, '{"cards": [{"id": "{{card}}"}]}', '{"frozen": "{{card}}"}', ["d1"], ["freeze"])
    templates = [
        template("i1", "bank", "t1", "verifiable", ["region:north"]), template("i1", "bank", "t2", "dynamic", None), template("i2", "brokerage", "t1", "verifiable", ["financial-literacy:high", "age:any"]),
        template("i3", "wealth_manager", "t9", "dynamic", []),
    ]
    schema = "institution_id string, institution_type string, template_id string, tier string, tags array<string>, openings array<string>, param_space map<string,array<string>>, account_state string, state_deltas string, gold_documents array<string>, gold_tools array<string>"
    categories = [("bank", "c1", "hi", ["region:north"]), ("bank", "c2", "ho", None), ("brokerage", "c3", "ha", [])]
    return people, spark.createDataFrame(templates, schema), spark.createDataFrame(categories, "institution_type string, category_id string, invitation string, affinities array<string>")


def test_verifiable_instances(spark):
    people, templates, _ = frames(spark)
    got = {r.persona_uuid: r for r in finance.instances(people, templates).collect()}
    assert len(got) == 200 and {r.tier for r in got.values()} == {"verifiable"}
    for k in range(200):
        r = got[f"p{k}"]
        allowed = {"i1"} if k % 3 else set()
        allowed |= {"i2"} if k % 3 == 0 else set()
        assert r.institution_id in (allowed or {"i1", "i2"}) and r.template_id == "t1"
        card = r.params["card"]
        assert set(r.params) == {"card"} and card in ("a", 'b"q')
        assert r.opening in (f"Block {card} please", f"My {card} and {{{{other}}}}")
        assert json.loads(r.account_state) == {"cards": [{"id": card}]} and json.loads(r.state_deltas) == {"frozen": card} and r.gold_tools == ["freeze"]
    assert {r.params["card"] for r in got.values()} == {"a", 'b"q'} and len({r.opening[:2] for r in got.values()}) == 2
    assert {r.persona_uuid: r.opening for r in finance.instances(people.repartition(5), templates).collect()} == {k: r.opening for k, r in got.items()}


def test_dynamic_instances(spark):
    people, templates, categories = frames(spark)
    got = finance.instances(people, templates, categories, mix=0.7).collect()
    assert len(got) == len({r.persona_uuid for r in got}) == 200
    dynamic = [r for r in got if r.tier == "dynamic"]
    assert 60 < len(dynamic) < 180 and {r.institution_type for r in dynamic} <= {"bank", "brokerage"}
    assert all((r.category_id in ("c1", "c2")) == (r.institution_type == "bank") and r.invitation and r.template_id is None for r in dynamic)
    north = [r for r in dynamic if r.institution_type == "bank" and int(r.persona_uuid[1:]) % 3]
    assert sum(r.category_id == "c1" for r in north) > sum(r.category_id == "c2" for r in north)
    assert all(r.template_id == "t1" for r in got if r.tier == "verifiable")
    none = finance.instances(people.limit(3), templates.limit(0), categories, mix=1.0).collect()
    assert len(none) == 3 and {(r.tier, r.institution_id) for r in none} == {("verifiable", None)}
