import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import judging, registry, reporting, simulation
from larkspur.sources import banks, runs


def test_converse_keeps_failures(spark):
    def make():
        def client(row):
            if row["id"] == 1:
                raise ValueError("no model")
            return {"id": row["id"], "text": f"hi {row['id']}"}

        return client

    got = {r.failure_detail or r.text: r.status for r in simulation.converse(spark.range(3), make, "id long, text string").collect()}
    assert got == {"hi 0": "ok", "hi 2": "ok", "ValueError: no model": "failed"}


def test_translation(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    got = simulation.translate_distinct(df, "t", lambda xs: [x.upper() for x in xs]).collect()
    assert sorted((str(r.t), str(r.translated)) for r in got) == [("None", "None"), ("a", "A"), ("a", "A"), ("b", "B")]


def test_compression(spark):
    df = spark.createDataFrame([([("u", "q"), ("a", "one"), ("a", "two"), ("a", "three")], {1: "1", 2: "2", 3: "3"})], "m array<struct<role:string,content:string>>, s map<int,string>")
    got = [m.content for m in df.select(simulation.compress_history(F.col("m"), F.col("s"), 2).alias("v")).first().v]
    assert got == ["q", "[Summary of previous response: 1]", "two", "three"]


def test_tools_and_calls(spark):
    rows = spark.createDataFrame([("a", "s"), ("b", "s")], "trajectory_id string, toolset string")
    tools = spark.createDataFrame([("s", f"t{i}") for i in range(9)], "toolset string, tool string")
    drawn = simulation.draw_tools(rows, tools, 3)
    assert drawn.count() == 6 and drawn.exceptAll(simulation.draw_tools(rows.repartition(3), tools.repartition(4), 3)).count() == 0
    calls = spark.createDataFrame([("a", 1, "f", "{}"), ("a", 2, "g", "{}"), ("a", 3, "f", "{}")], "trajectory_id string, call_no int, name string, arguments string")
    assert {r.call_no: r.same_as for r in simulation.earlier_calls(calls).collect()} == {1: None, 2: None, 3: 1}


def test_outcomes(spark):
    e = spark.createDataFrame(
        [("a", 1, "call", "m", 5, 7, 0.5, None), ("a", 2, "call", "m", 1, 1, 0.5, None), ("a", 3, "warning", None, None, None, None, "w2"), ("a", 4, "turn", None, None, None, None, None), ("b", 1, "failure", None, None, None, None, "timeout:user_model"), ("c", 1, "turn", None, None, None, None, None)],
        "trajectory_id string, seq int, kind string, alias string, input_tokens int, output_tokens int, seconds double, detail string",
    )
    got = {r.trajectory_id: r for r in simulation.outcomes(e).collect()}
    assert got["a"].status == "completed_with_warnings" and got["a"].per_model_output_tokens == {"m": 8} and got["a"].warnings == ["w2"] and got["a"].n_turns == 1
    assert (got["b"].status, got["b"].failure_class, got["b"].failure_attribution) == ("failed", "timeout", "user_model") and got["c"].status == "ok"


def test_guard(spark):
    rows = [("a", 0, 6, "open", "disclose", "p"), ("a", 2, 6, "open", "disclose", "p"), ("a", 3, 6, "open", "disclose", "p"), ("a", 3, 6, "open", "hint_risk", None), ("a", 4, 6, "covert_risk", "reveal_risk", None), ("b", 3, 5, "covert_risk", "reveal_risk", None)]
    df = spark.createDataFrame(rows, "trajectory_id string, turn int, num_turns int, archetype string, move string, topic string")
    got = {(r.trajectory_id, r.turn, r.move): r.reason for r in simulation.guard_moves(df).collect()}
    assert got == {("a", 0, "disclose"): "disclosed too early", ("a", 2, "disclose"): "ok", ("a", 3, "disclose"): "told already", ("a", 3, "hint_risk"): "risk too early", ("a", 4, "reveal_risk"): "ok", ("b", 3, "reveal_risk"): "revealed too early"}


def test_families(spark):
    df = spark.createDataFrame([("openai/gpt-5",), ("meta-llama/x",), ("Qwen3",), ("home-made",)], "m string")
    assert [r.f for r in df.select(judging.family(F.col("m")).alias("f")).collect()] == ["openai", "llama", "qwen", "other"]
    judging.check_diversity(["other"])
    for bad in (["openai", "openai"], ["other", "other"]):
        with pytest.raises(ValueError):
            judging.check_diversity(bad)


def test_verdicts(spark):
    cells = [None, "{}", json.dumps({"axes": {"a": {"j": {"score": 3}}}}), json.dumps({"axes": {"a": {"j": {"score": None}}}}), json.dumps({"skipped": True, "axes": {"a": {"j": {"score": 1}}}}), json.dumps({"skipped": True, "skipped_reason": "envelope_match", "axes": {"a": {"j": {"score": 1}}}})]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i")
    assert [r.v for r in df.select(judging.verdict(F.col("c")).alias("v")).collect()] == ["not_applicable", "not_applicable", "scored", "missing", "not_applicable", "scored"]
    again = df.select(judging.needs_judging(F.col("c")).alias("v")).collect()
    assert [r.v for r in again] == [True, False, False, True, False, False]


def test_axis_columns_and_tally(spark):
    df = spark.createDataFrame([("en", '{"safety": {"score": 4}}', ["placeholder_seed"]), ("en", "bad", ["used_machine_translation"]), ("de", None, [])], "locale string, eval_scores string, warning_kinds array<string>")
    rows = judging.axis_columns(df, ["safety", "other"]).collect()
    assert [(r.locale, r.score_safety, r.score_other) for r in rows] == [("en", 4.0, None)]
    got = {r.locale: (r.n_placeholder, r.n_machine_translated, r.unreviewed) for r in judging.content_tally(df, ["locale"]).collect()}
    assert got == {"en": (1, 1, True), "de": (0, 0, False)}


def test_registry_does_not_displace():
    extra = reporting.Capability("extra", "mean", 4.0, ("safety",))
    taken = reporting.Capability("assistant_quality", "mean", 1.0)
    merged = {c.id: c for c in registry.merge(reporting.CAPABILITIES, [extra, [taken]])}
    assert merged["extra"] is extra and merged["assistant_quality"].threshold == 4.0 and registry.capabilities()


def test_banks(spark, tmp_path):
    folder = tmp_path / "en_US" / "facts"
    folder.mkdir(parents=True)
    (folder / "seeds.json").write_text('[{"id": "a", "tags": ["x"]}]')
    root = f"file://{tmp_path}"
    assert banks.load_seeds(spark, root, "de_DE", "facts", "seeds") == [{"id": "a", "tags": ["x"]}] and banks.load_seeds(spark, root, "de_DE", "none", "seeds") == []
    row = banks.bank_frame(spark, f"{folder}/seeds.json", "facts", "id string, tags string").first()
    assert (row.id, row.tags) == ("a", '["x"]') and banks.load_vectors(spark, f"{root}/none") is None


def test_publish_and_lock(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    df = spark.createDataFrame([("a", "en", "p")], "trajectory_id string, locale string, probe_family string")
    assert [runs.publish_new_run(df, root, "5"), runs.publish_new_run(df, root, "5")] == ["5", "6"]
    assert runs.list_runs(spark, root) == ["5", "6"]
    with runs.run_lock(spark, root, "5"):
        with pytest.raises(RuntimeError):
            with runs.run_lock(spark, root, "5"):
                pass
    with runs.run_lock(spark, root, "5"):
        pass
    runs.write_reports(spark, f"{root}/reports", {"small": df})
    assert runs.read_json(spark, f"{root}/reports/small.json")["rows"][0]["trajectory_id"] == "a"
    with pytest.raises(ValueError):
        runs.write_reports(spark, f"{root}/reports", {"small": df}, limit=0)
