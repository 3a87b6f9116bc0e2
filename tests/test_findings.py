import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import findings as f
from larkspur.operators import reporting


def test_quantiles_against_numpy(spark):
    rnd = random.Random(2)
    rows = [(g, rnd.choice([None, rnd.randint(0, 9), rnd.randint(0, 10**6)])) for g in "abc" for _ in range(rnd.randint(1, 300))] + [("d", 7), ("e", None), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    fractions = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r.g: r for r in reporting.exact_quantiles(df, ["g"], "v", fractions, [F.col("v") * 2]).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert r.n == len(own) and r.mean == pytest.approx(np.mean(own)) and r.sum0 == 2 * sum(own)
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx([np.quantile(own, q) for q in fractions])


def test_lengths_of_null_texts(spark):
    rows = [("a", "four"), ("a", None), ("b", None)]
    got = {r.k: r for r in reporting.response_lengths(spark.createDataFrame(rows, "k string, text string"), "k").collect()}
    assert (got["a"].n_turns, got["a"].mean_chars, got["b"].n_turns, got["b"].p95_chars) == (2, 4.0, 1, None)


def test_first_rows_are_limited_before_the_shuffle(spark):
    df = reporting.first_rows(spark.range(1000).withColumn("g", F.col("id") % 3), ["g"], ["id"], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4, 5]


def test_findings_of_judges_and_scorers(spark):
    cap = reporting.Capability("safe", "critical_axis", 4.0, ("safety", "tone", "refusal.x_rate", "none"), critical=("safety",), axis_thresholds={"refusal.x_rate": 0.95}, owners={"refusal.x_rate": "refusal_basics"})
    cell = {
        "axes": {"safety": {"b": {"score": 2, "reasoning": "bad"}, "a": {"score": 4}}, "tone": {"a": {"score": None, "reasoning": "unclear"}}, "none": {"a": {"score": None}}},
        "scorers": {"refusal_basics": {"scores": {"refusal.x_rate": {"score": 0.97, "reasoning": "few"}}}},
    }
    broken = {"axes": {}, "scorers": {"refusal_basics": {"error": "boom"}}}
    df = spark.createDataFrame([(1, json.dumps(cell)), (2, json.dumps(broken)), (3, "nope"), (4, None)], "k int, c string")
    got = {r.k: [tuple(x) for x in r.x] for r in df.select("k", f.findings(F.col("c"), cap).alias("x")).collect()}
    assert got[1] == [
        ("safety", "judge", "b", 3.0, 4.0, True, True, "bad"),
        ("tone", "judge", "a", None, 4.0, False, False, "unclear"),
        ("refusal.x_rate", "scorer:refusal_basics", None, 0.97, 0.95, False, False, "few"),
    ]
    assert got[2] == [("refusal_basics (scorer error)", "scorer:refusal_basics", None, None, None, True, False, "boom")] and got[3] == got[4] == []
    flip = reporting.Capability("p", "critical_axis", 4.0, ("pressure.held",), "safety_chat_pressure")
    cell = {"scorers": {"safety_chat_pressure": {"turn_of_flip": 3, "scores": {"pressure.held": {"score": 1, "reasoning": "gave in"}}}}}
    one = spark.createDataFrame([(json.dumps(cell),)], "c string").select(f.findings(F.col("c"), flip).alias("x")).first().x
    assert [(x.axis, x.score, x.failed) for x in one] == [("pressure.held", 1.0, True), ("turn_of_flip", None, False)] and "3" in one[1].reasoning


def test_ratings_and_transcripts(spark):
    ratings = [
        {"turn_idx": 2, "attempt": 0, "rating": "low", "success": False}, {"turn_idx": 1, "attempt": 1, "rating": "ok", "explanation": "e", "success": True},
        {"turn_idx": 1, "attempt": 0, "rating": "old"}, {"turn_idx": 2, "attempt": 0, "rating": "again"}, {"rating": "unnumbered"},
    ]
    messages = [
        {"role": "system", "content": "s"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "find"}}, {"name": "get"}]},
        {"role": "tool", "content": "r"}, {"role": "assistant", "content": " one "}, {"role": "user"}, {"role": "assistant", "content": "two"},
    ]
    df = spark.createDataFrame([(json.dumps(messages), json.dumps({"assistant_judge_ratings": ratings})), ("x", "[]"), (None, None)], "m string, d string")
    a, b, c = df.select(f.turn_ratings(F.col("d")).alias("r"), f.transcript(F.col("m")).alias("t"), f.aligned_turns(F.col("m"), F.col("d"), 1).alias("l")).collect()
    assert [tuple(x) for x in a.r] == [(1, 1, "ok", "e", True), (2, 0, "again", "", False), (None, 0, "unnumbered", "", False)]
    assert [tuple(x) for x in a.t] == [("user", "hi", False), ("assistant", "tool_call: find, get", True), ("tool", "r", False), ("assistant", " one ", False), ("user", "", False), ("assistant", "two", False)]
    assert [tuple(x) for x in a.l] == [(3, 1, " one ", "ok"), (5, 2, "two", "again")]
    zero = df.select(f.aligned_turns(F.col("m"), F.col("d")).alias("l")).first().l
    assert [(x.turn_idx, x.rating) for x in zero] == [(0, None), (1, "ok")]
    assert b.r == b.t == b.l == c.r == c.t == c.l == []


def test_the_worst_rows_of_each_cell(spark):
    cap = reporting.Capability("q", "mean", 4.0, ("accuracy",))
    rows = [(f"t{k:02}", "en" if k < 8 else "de", json.dumps({"axes": {"accuracy": {"j": {"score": 1 + k % 5, "reasoning": f"r{k}"}}}}), json.dumps({"status": "ok"})) for k in range(12)]
    df = spark.createDataFrame(rows, "trajectory_id string, locale string, assistant_eval string, simulation_outcome string")
    got = f.evidence_findings(df, reporting.evidence(df, [cap]), [cap], per_cell=2).orderBy("locale", "rank").collect()
    assert [(r.locale, r["rank"], r.trajectory_id, r.findings[0].score, r.findings[0].failed, r.findings[0].reasoning, r.turns) for r in got] == [
        ("de", 1, "t10", 1.0, True, "r10", []), ("de", 2, "t11", 2.0, True, "r11", []), ("en", 1, "t00", 1.0, True, "r0", []), ("en", 2, "t05", 1.0, True, "r5", []),
    ]
