import json

import pytest

from larkspur.operators import comparison, reporting


def cell(axes=None, scorers=None):
    return json.dumps({"axes": {a: {"j": {"score": s}} for a, s in (axes or {}).items()}, "scorers": scorers or {}})


@pytest.fixture(scope="module")
def rows(spark):
    ok, failed = json.dumps({"status": "ok"}), json.dumps({"status": "failed", "failure_class": "timeout", "failure_attribution": "user"})
    data = [(f"e{i}", "en", ok, cell({"safety": s, "coherence": 5.0})) for i, s in enumerate((5.0, 5.0, 1.0))]
    data += [("d0", "de", ok, cell({"safety": 5.0})), ("d1", "de", failed, cell({"safety": 1.0})), ("f0", "fr", None, None)]
    return spark.createDataFrame(data, "trajectory_id string, locale string, simulation_outcome string, assistant_eval string")


CAPS = (
    reporting.Capability("safe", "critical_axis", 2.0, ("safety", "coherence"), critical=("safety",)),
    reporting.Capability("avg", "mean", 3.0, ("safety",)),
    reporting.Capability("works", "success_rate", 0.95, scale="rate"),
)


def test_states(rows):
    cells = reporting.capability_cells(reporting.evidence(rows, CAPS), CAPS, min_n=2).collect()
    state = {(r.capability, r.locale): (r.state, r.n, r.n_total) for r in cells}
    assert state["safe", "en"] == ("blocked", 3, 3)  # a must-pass axis failed although the mean passes
    assert state["avg", "en"] == ("ready", 3, 3)
    assert state["avg", "de"] == ("insufficient_evidence", 1, 2)  # the failed row gives no evidence
    assert state["avg", "fr"] == ("missing", 0, 1)
    assert state["works", "de"] == ("blocked", 2, 2)


def test_triage_order(rows):
    cells = reporting.capability_cells(reporting.evidence(rows, CAPS), CAPS, min_n=2)
    got = [r.priority for r in reporting.triage(cells).collect()]
    assert got == sorted(got) and got[0] == "P0"


def test_failures_over_all_rows(rows):
    r = reporting.failure_taxonomy(rows).collect()
    assert [(x.failure_class, x.n, round(x.proportion, 4)) for x in r] == [("timeout", 1, 0.1667)]


def test_resources(spark):
    o = lambda **k: json.dumps(k)
    df = spark.createDataFrame([(o(per_model_calls={"a": 2, "b": 1}, wall_clock_s_by_alias={"a": 0.5}),), (o(per_model_calls={"a": 1}),), (None,), ("broken",)], "simulation_outcome string")
    got = {r.alias: (r.calls, r.wall_clock_s) for r in reporting.resource_profile(df).collect()}
    assert got == {"a": (3, 0.5), "b": (1, 0.0)}


def brute_pareto(rows):
    ok = [(s, c) for s, c in rows if s is not None and c > 0]
    return sorted((s, c) for s, c in ok if not any(a > s and b < c for a, b in ok))


def test_pareto(spark):
    data = [(3.0, 2.0), (3.0, 2.0), (2.0, 1.0), (2.0, 3.0), (None, 1.0), (9.0, 0.0), (1.0, 1.0), (4.0, 9.0)]
    got = comparison.pareto(spark.createDataFrame(data, "s double, c double"), "s", "c").collect()
    assert sorted((r.s, r.c) for r in got) == brute_pareto(data)


def test_cube_and_rollup(spark):
    df = spark.createDataFrame(
        [("1", "safe", "en", 0.8, "ready"), ("1", "safe", "de", 0.4, "blocked"), ("1", "avg", "en", 0.6, "ready"), ("2", "safe", "en", 0.5, "ready"), ("2", "simulation_reliability", "en", 1.0, "ready")],
        "run_id string, capability string, locale string, score double, state string",
    )
    cube = comparison.cube(df, df)
    assert cube.count() == 2 * 3 * 2 and cube.where("state = 'missing'").count() == 12 - 5
    got = {r.run_id: (r.mean_score, r.n_ready) for r in comparison.rollup_runs(cube).collect()}
    assert got["1"] == (pytest.approx((0.7 + 0.4) / 2), 2) and got["2"] == (0.5, 2)


def test_axes_of_a_failed_scorer_give_no_evidence(spark):
    ok = json.dumps({"status": "ok"})
    scores = {"shape.over_formatted_rate": "0.2"}
    data = [("a", "en", ok, cell({"response_conciseness": 5.0}, {"response_shape": {"scores": scores}})), ("b", "en", ok, cell({"response_conciseness": 5.0}, {"response_shape": {"scores": scores, "error": "crashed"}}))]
    df = spark.createDataFrame(data, "trajectory_id string, locale string, simulation_outcome string, assistant_eval string")
    caps = [c for c in reporting.CAPABILITIES if c.id == "conversation_formatting"]
    got = {r.trajectory_id: r.row_score for r in reporting.evidence(df, caps).collect()}
    assert got == {"a": pytest.approx(0.6), "b": 1.0}
    c = reporting.capability_cells(reporting.evidence(df, caps), caps, min_n=1).first()
    assert (c.state, c.failed_axes) == ("blocked", ["shape.over_formatted_rate"])


def test_strata(spark):
    base = reporting.PROBE_CAPABILITIES[0]
    made = reporting.by_stratum(base, "institution_type", ["bank", "insurer"])
    assert [c.id for c in made] == ["financial_task_success_bank", "financial_task_success_insurer"] and made[1].row_filter == {"institution_type": "insurer"}
    df = spark.createDataFrame([("a", "en", json.dumps({"status": "ok"}), cell({}, {"financial_services": {"scores": {"finance.tool_selection_rate": "1.0"}}}), "bank")], "trajectory_id string, locale string, simulation_outcome string, assistant_eval string, institution_type string")
    assert [r.capability for r in reporting.evidence(df, made).collect()] == ["financial_task_success_bank"]
    assert len({c.id for c in (*reporting.CAPABILITIES, *reporting.PROBE_CAPABILITIES)}) == len(reporting.CAPABILITIES) + len(reporting.PROBE_CAPABILITIES)
