import json

import pytest

from larkspur.operators import manifest, preview
from larkspur.sources import runs


@pytest.mark.parametrize(
    "outcome, completed, want",
    [
        ({"status": "ok", "warnings": [{"kind": "x"}]}, None, "SIM OK"),
        ({"status": "failed"}, True, "SIM FAIL"),
        ({"status": "completed_with_warnings", "warnings": [{"kind": "used_placeholder_query"}]}, None, "SIM OK"),
        ({"status": "completed_with_warnings", "warnings": [{"kind": "a"}, {"kind": "used_placeholder_query"}]}, None, "SIM WARN"),
        ({"status": "other", "warnings": [{"kind": "a"}]}, True, "SIM WARN"),
        ({"status": "other"}, True, "SIM OK"),
        (None, True, "SIM OK"),
        (None, None, "SIM FAIL"),
    ],
)
def test_status(spark, outcome, completed, want):
    df = spark.createDataFrame([(1, outcome and json.dumps(outcome), completed)], "trajectory_id int, simulation_outcome string, conversation_status boolean")
    assert preview.preview_rows(df).first().status == want


def test_rows_and_counts(spark):
    warnings = [{"kind": k} for k in ("b", "a", "b", "", "old_placeholder", "b")] + [{"turn_idx": 1}]
    rows = [
        (1, json.dumps({"status": "completed_with_warnings", "warnings": warnings}), "facts", "terse", "polite", "4", None, " "),
        (2, json.dumps({"status": "ok", "warnings": [{"kind": "a"}]}), None, "terse", None, "x", "2", "f"),
        (3, "broken", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "trajectory_id int, simulation_outcome string, probe_type string, user_behavior string, interaction_style string, num_turns string, num_tool_calls string, sex string")
    got = {r.trajectory_id: tuple(r)[1:] for r in preview.preview_rows(df).collect()}
    assert got == {
        1: ("SIM WARN", "b×3, a", "facts", "terse/polite", 4, 0, "—", "—", "—"),
        2: ("SIM OK", "a", "—", "—", 0, 2, "—", "—", "f"),
        3: ("SIM FAIL", "", "—", "—", 0, 0, "—", "—", "—"),
    }
    assert tuple(preview.preview_counts(preview.preview_rows(df)).first()) == (3, 1, 1, 1)
    assert {tuple(r) for r in preview.warning_counts(df).collect()} == {("b", 1, 3), ("a", 2, 2)}


def test_run_to_resume(spark, tmp_path):
    root = f"file://{tmp_path}/data"
    assert manifest.sampled_run_to_resume(spark, root) is None
    for run in ("1", "2", "3"):
        runs.write_run(spark.createDataFrame([("a", "en", "p")], "trajectory_id string, locale string, probe_family string"), root, run)
    runs.write_json(spark, f"{root}/run=3/_run.json", {"kind": "stored"})
    assert manifest.sampled_run_to_resume(spark, root) == "2"
    runs.write_json(spark, f"{root}/run=2/_run.json", {"kind": "stored"})
    runs.write_json(spark, f"{root}/run=1/_run.json", {"kind": "sampled"})
    assert manifest.sampled_run_to_resume(spark, root) == "1"
