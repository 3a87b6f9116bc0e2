import hashlib
import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import cells, identity, text


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "turns, want",
    [([], None), (["a b"], None), (["a b c", "d", "e f"], 2.0), (["a", "", " "], None), (["a　b", "c"], 2.0)],
)
def test_front_loading(spark, turns, want):
    assert one(spark, text.front_loading(F.col("t")), t=turns) == want


def test_verbosity(spark):
    assert one(spark, text.verbosity_cv(F.col("t")), t=["a", "a b c"]) == pytest.approx(0.5)
    assert one(spark, text.verbosity_cv(F.col("t")), t=["a"]) is None


def test_markers_stand_as_words(spark):
    assert one(spark, text.marker_fraction(F.col("t"), text.POLITE), t=["Thanks!", "pleased", "no"]) == pytest.approx(1 / 3)
    assert one(spark, text.marker_fraction(F.col("t"), text.POLITE), t=[]) is None


def test_mattr(spark):
    tokens = [str(i % 7) for i in range(60)]
    want = sum(len(set(tokens[i : i + 50])) / 50 for i in range(11)) / 11
    assert one(spark, text.mattr(F.col("t")), t=tokens) == pytest.approx(want)
    assert one(spark, text.mattr(F.col("t")), t=[]) == 0.0
    assert one(spark, text.mattr(F.col("t")), t=["a", "a"]) == 0.5


@pytest.mark.parametrize("t, want", [("", True), ("ok", True), ("...", True), ("👍👍👍👍", True), ("yes", False), ("  　 ", True), ("はいはい", False)])
def test_trivial(spark, t, want):
    assert one(spark, text.is_trivial(F.col("t")), t=t) is want


@pytest.mark.parametrize(
    "t, want",
    [
        ("# a\n# b", True),
        ("# a\nb", False),
        ("a\n---\nb", True),
        ("| a | b |", True),
        ("\n".join(f"{i}. x" for i in range(6)), True),
        ("\n".join(f"- x{i}" for i in range(5)), False),
        ("```py\n" + "x\n" * 6 + "```", True),
        ("```py\nx\n```", False),
    ],
)
def test_over_formatted(spark, t, want):
    assert one(spark, text.is_over_formatted(F.col("t")), t=t) is want


@pytest.mark.parametrize("t, want", [("Done.", False), ("and then", True), ("(open.", True), ("fine)", False), ("「終わり。", True), ("  ", False), ("नमस्ते।", False)])
def test_truncated(spark, t, want):
    assert one(spark, text.looks_truncated(F.col("t")), t=t) is want


def test_script_share(spark):
    assert one(spark, text.letter_share(F.col("t"), "Latin"), t="abж1") == pytest.approx(2 / 3)
    assert one(spark, text.letter_share(F.col("t"), "Latin"), t="12") is None


def test_cjk_words(spark):
    assert one(spark, text.cjk_word_count(F.col("t")), t="漢字かな two") == 3


@pytest.mark.parametrize("key", ["", "a", "persona-1", "é"])
def test_md5_bucket(spark, key):
    assert one(spark, identity.md5_bucket(F.col("k")), k=key) == int(hashlib.md5(key.encode()).hexdigest(), 16) % 10_000


def test_ids(spark):
    want = hashlib.sha256(b"a||3").hexdigest()[:16]
    assert one(spark, identity.joined_id(F.lit("a"), F.lit(None), F.lit(3))) == want
    doc = json.dumps({"b": 'q"\\é', "a": None}, sort_keys=True, ensure_ascii=False)
    got = one(spark, identity.persona_hash({"b": F.col("b"), "a": F.lit(None).cast("string")}), b='q"\\é')
    assert got == hashlib.sha256(doc.encode()).hexdigest()[:16]


def test_rendezvous_is_stable(spark):
    keys = spark.range(200).select(F.col("id").cast("string").alias("k"))
    bank = lambda *xs: F.array(*[F.lit(x) for x in xs])
    rows = keys.select(identity.rendezvous_pick(F.col("k"), bank("a", "b", "c")).alias("x"), identity.rendezvous_pick(F.col("k"), bank("a", "b")).alias("y")).collect()
    assert all(r.x == r.y for r in rows if r.x != "c") and {r.x for r in rows} == {"a", "b", "c"}


def test_weighted_pick_shares(spark):
    rows = spark.range(4000).select(identity.weighted_pick(F.col("id"), {"a": 3, "b": 1}).alias("x")).groupBy("x").count().collect()
    assert {r.x: r["count"] for r in rows}["a"] == pytest.approx(3000, abs=150)


@pytest.mark.parametrize(
    "entry, persona, overlap, each, every",
    [
        ([], ["a:1"], True, True, True),
        (["a:1"], ["a:1", "b:2"], True, True, True),
        (["a:1", "b:3"], ["a:1", "b:2"], True, False, False),
        (["a:any"], ["a:9"], True, True, True),
        (["a:1"], ["a:any"], True, True, False),
        (["bare", "a:1"], ["a:1"], True, False, False),
        (["c:1"], ["a:1"], False, False, False),
    ],
)
def test_tags(spark, entry, persona, overlap, each, every):
    e, p = F.col("e"), F.col("p")
    got = [one(spark, f(e, p), e=entry, p=persona) for f in (identity.tag_overlap, identity.tag_each_prefix, identity.tag_all)]
    assert got == [overlap, each, every]


@pytest.mark.parametrize("raw", [None, "", "nonsense", "[1]", "{"])
def test_undecodable_cells_are_null(spark, raw):
    assert one(spark, cells.parse_cell(F.col("c")), c=raw) is None or raw == "{"
    assert one(spark, F.size(cells.parse_messages(F.col("c"))), c=raw) == (1 if raw == "[1]" else 0) or raw == "[1]"


@pytest.mark.parametrize("raw, want", [('{"score": 3}', 3.0), ("2.5", 2.5), ("NaN", None), ('{"score": null}', None), ("x", None), (None, None)])
def test_number_in(spark, raw, want):
    assert one(spark, cells.number_in(F.col("c")), c=raw) == want


def test_scorer_states(spark):
    cell = json.dumps({"scorers": {"a": {"scores": {}}, "b": {"error": "no turns: scorer skipped"}, "c": {"error": "locale=xx: scorer skipped"}}})
    c = cells.parse_cell(F.col("c"))
    got = [one(spark, cells.scorer_state(F.element_at(c["scorers"], n)), c=cell) for n in "abcd"]
    assert got == ["ok", "not_applicable", "error", None]


def test_scales(spark):
    assert one(spark, cells.normalized(F.lit("safety"), F.lit(1.0))) == pytest.approx(0.2)
    assert one(spark, cells.normalized(F.lit("shape.x"), F.lit(0.5))) == 0.5
    assert one(spark, cells.normalized(F.lit("any_rate"), F.lit(0.5))) == 0.5


def test_rules_against_every_pair(spark):
    """The rule that decides, by trying each pattern on each id."""
    import fnmatch
    import re

    from larkspur.functions import identity

    ids = ["meta-llama/Meta-Llama-3-8B", "meta.llama3-3-70b-v1:0", "llama3.1:8b", "collama3", "org/Own-Model", "OWN-model", "a/b@gpt-4o", "gpt-4o", "x(y)+z", "", " llama3 ", None]
    rules = ["llama*", "own-model", "org/*", "*-4o", "gpt-?o", "x(y)+?", "gpt-4o", "meta*/meta*8b", "zzz"]
    got = {r.model_id: r.pattern for r in identity.matched_rule(spark.createDataFrame([(i,) for i in ids * 2], "model_id string"), spark.createDataFrame([(k, p, f"d{k}") for k, p in enumerate(rules)], "place int, pattern string, developer string")).collect()}

    def hit(p, i):
        if "[" in p:
            return False
        body = fnmatch.translate(p.lower())
        return re.search(("^" if "/" in p else "(?:^|(?<=[/:@.-]))") + body, i.strip().lower()) is not None

    for i in ids:
        order = sorted(range(len(rules)), key=lambda k: (any(c in rules[k] for c in "*?"), k))
        want = None if i is None else next((rules[k] for k in order if hit(rules[k], i)), None)
        assert got[i] == want, i
    assert len(got) == len(ids)
    none = identity.matched_rule(spark.createDataFrame([("x",)], "model_id string"), spark.createDataFrame([], "place int, pattern string, developer string")).collect()
    assert [(r.model_id, r.developer) for r in none] == [("x", None)]
