import json
from dataclasses import replace

import pytest

from larkspur.operators import selection


def cell(axes=None, scorers=None, skipped=False):
    return json.dumps({"skipped": skipped, "axes": axes or {}, "scorers": scorers or {}})


def judges(*scores):
    return {f"j{k}": {"score": s, "reasoning": ""} for k, s in enumerate(scores)}


def outcome(status="ok", turns=3, **more):
    return json.dumps({"status": status, "n_turns": turns, **more})


@pytest.fixture(scope="module")
def frames(spark):
    t = spark.createDataFrame(
        [
            ("a", "p1", "en", "x", outcome()),
            ("b", "p2", "en", "x", outcome("failed")),
            ("c", "p3", "de", "y", outcome(turns=0)),
            ("d", "p4", "de", "y", outcome()),
            ("e", "p5", "fr", "y", None),
            ("f", "p6", "fr", "y", outcome(n_user_role_violations=2)),
            ("g", None, "fr", None, outcome("completed_with_warnings")),
        ],
        "trajectory_id string, persona_uuid string, locale string, probe_family string, simulation_outcome string",
    )
    e = spark.createDataFrame(
        [
            ("a", cell({"safety": judges(4, 5), "coherence": judges(3)})),
            ("b", cell({"safety": judges(5)})),
            ("c", cell({"safety": judges(1)})),
            ("d", cell(skipped=True)),
            ("e", cell({"safety": judges(5)})),
            ("f", cell({"safety": judges(1, 5)}, {"response_shape": {"error": "crashed"}})),
            ("g", "not json"),
        ],
        "trajectory_id string, assistant_eval string",
    )
    return t, e


def verdicts(frames, profile=selection.GENEROUS):
    rows = selection.select_trajectories(*frames, profile=profile)[1].collect()
    return {r.trajectory_id: r for r in rows}


def test_drop_reasons_in_order(frames):
    got = {k: r.selection_drop_reason for k, r in verdicts(frames).items()}
    assert got == {"a": None, "b": "status", "c": "min_turns", "d": "skipped", "e": "status", "f": None, "g": "no_eval"}


def test_quality_is_mean_of_fifths(frames):
    v = verdicts(frames)
    assert v["a"].selection_quality_score == pytest.approx((0.9 + 0.6) / 2)
    assert v["d"].selection_quality_score is None


def test_soft_scorer_error_and_hard_first(frames):
    v = verdicts(frames, replace(selection.GENEROUS, max_judge_spread=3.0, counter_caps={"n_user_role_violations": 1}))
    assert json.loads(v["f"].selection_failed_gates) == ["health:n_user_role_violations", "judge_disagreement:safety", "shape.empty_or_trivial_rate:scorer_error"]


def test_soft_floor_is_only_recorded(frames):
    v = verdicts(frames, replace(selection.GENEROUS, floors={"safety": 4.9}, critical=frozenset()))
    assert v["a"].selection_passed and json.loads(v["a"].selection_failed_gates) == ["safety"]


def test_split_only_for_passed(frames):
    v = verdicts(frames, selection.with_holdout(selection.GENEROUS, 1.0))
    assert v["a"].selection_split == "holdout" and v["b"].selection_split is None


def allocate(counts, total):
    """Round by round, one slot to each stratum that still has rows."""
    quotas = dict.fromkeys(counts, 0)
    left = min(total, sum(counts.values()))
    while left:
        for k in sorted(counts):
            if left and quotas[k] < counts[k]:
                quotas[k] += 1
                left -= 1
    return quotas


@pytest.mark.parametrize("total", [0, 1, 3, 4, 7, 11, 50])
def test_even_shares(spark, total):
    counts = {"a": 5, "b": 1, "c": 3}
    rows = [(f"{s}{i}", s, float(i)) for s, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "trajectory_id string, probe_family string, selection_quality_score double")
    got = selection.cap_total(df, total, ["probe_family"]).groupBy("probe_family").count().collect()
    assert {r[0]: r[1] for r in got} == {k: v for k, v in allocate(counts, total).items() if v}


def test_null_stratum_is_one(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", None, 2.0), ("c", "x", 1.0)], "trajectory_id string, probe_family string, selection_quality_score double")
    assert {r[0] for r in selection.cap_total(df, 2, ["probe_family"]).collect()} == {"b", "c"}


def test_nulls_rank_last(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", 0.1)], "trajectory_id string, locale string, selection_quality_score double")
    assert [r[0] for r in selection.cap_per_group(df, 1, ["locale"]).collect()] == ["b"]


def test_columns():
    have = ["trajectory_id", "locale", "probe_family", "conversation_messages", "persona_verbatim", "extra"]
    assert selection.resolve_columns("compact", have) == ["trajectory_id", "probe_family", "locale", "conversation_messages"]
    assert "persona_verbatim" not in selection.resolve_columns("full", have) and "extra" in selection.resolve_columns("full", have)
    with pytest.raises(ValueError):
        selection.resolve_columns(["nope"], have)
