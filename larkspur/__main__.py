"""Command line: ``python -m larkspur runs|select|report|rescore|smoke``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cells import parse_messages
from .operators import registry, reporting, scoring, selection
from .sources import runs

PROFILES = {"generous": selection.GENEROUS, "strict": selection.STRICT}


def _session() -> SparkSession:
    return SparkSession.builder.appName("larkspur").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _pair(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return runs.read_dataset(spark, a.trajectories, run=a.run), runs.read_dataset(spark, a.evaluations, run=a.run)


def show_runs(spark: SparkSession, a: argparse.Namespace) -> None:
    for run in runs.list_runs(spark, a.root):
        print(run)


def select(spark: SparkSession, a: argparse.Namespace) -> None:
    t, e = _pair(spark, a)
    profile = selection.with_holdout(PROFILES[a.profile], a.holdout)
    strata = a.stratify_by.split(",") if a.stratify_by else None
    curated, every = selection.select_trajectories(t, e, profile=profile, max_records=a.max_records, max_per_locale=a.max_per_locale, stratify_by=strata)
    kept = curated.select(*selection.resolve_columns(a.columns, curated.columns))
    funnel: dict[str, dict[str, int]] = {}
    for r in selection.funnel(every, curated).toLocalIterator():
        funnel.setdefault(r.kind, {})[r.name] = r.n
    runs.write_curated(kept, a.out, runs.resolve_run(spark, a.trajectories, a.run) or "all", profile.label, {"profile": profile.label, **funnel})
    print(json.dumps(funnel, sort_keys=True))


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    t, e = _pair(spark, a)
    lacking = [c for c in t.columns if c not in e.columns]
    joined = e.join(selection.keep_first(t.select("trajectory_id", *lacking), ["trajectory_id"], ["trajectory_id"]), "trajectory_id", "left")
    caps = registry.capabilities()
    cells = reporting.capability_cells(reporting.evidence(joined, caps), caps, min_n=a.min_n)
    frames = {
        "capability_cells": cells,
        "triage": reporting.triage(cells),
        "coverage": reporting.coverage_matrix(joined, scoring.scorer_names()),
        "sim_health": reporting.sim_health(t),
        "failures": reporting.failure_taxonomy(t, ["locale"]),
        "resources": reporting.resource_profile(t),
    }
    runs.write_reports(spark, a.out, frames)
    print("\n".join(f"{a.out}/{n}.json" for n in frames))


def rescore(spark: SparkSession, a: argparse.Namespace) -> None:
    t, e = _pair(spark, a)
    said = F.transform(F.filter(parse_messages(F.col("conversation_messages")), lambda m: (m["role"] == "assistant") & m["tool_calls"].isNull() & (F.trim(m["content"]) != "")), lambda m: m["content"])
    facts = t.select("trajectory_id", said.alias("turns"), F.substring("locale", 1, 2).alias("language"))
    out = scoring.rescore(e, facts, a.scorers.split(",") if a.scorers else scoring.scorer_names())
    print(runs.publish_new_run(out, a.evaluations, str(int(runs.resolve_run(spark, a.evaluations, a.run)) + 1)))


def smoke_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Six made-up conversations and their evaluations; nothing is called."""
    say = lambda *texts: json.dumps([{"role": r, "content": c} for r, c in texts])
    rows, cells = [], []
    for k in range(6):
        status = "failed" if k == 3 else "ok"
        rows.append((f"t{k}", f"p{k % 4}", ("en_US", "de_DE")[k % 2], "general_open_ended", json.dumps({"status": status, "n_turns": 2, "per_model_calls": {"assistant": 2}}), say(("user", "hello"), ("assistant", "Here is the answer." if k else "ok"))))
        cells.append((f"t{k}", ("en_US", "de_DE")[k % 2], "general_open_ended", json.dumps({"axes": {a: {"j": {"score": float(1 + (k + n) % 5)}} for n, a in enumerate(("helpfulness", "accuracy", "coherence", "safety"))}, "scorers": {}})))
    t = spark.createDataFrame(rows, "trajectory_id string, persona_uuid string, locale string, probe_family string, simulation_outcome string, conversation_messages string")
    return t, spark.createDataFrame(cells, "trajectory_id string, locale string, probe_family string, assistant_eval string")


def smoke(spark: SparkSession, a: argparse.Namespace) -> None:
    t, e = smoke_frames(spark)
    runs.write_run(t, f"{a.out}/trajectories", "1")
    runs.write_run(e, f"{a.out}/evaluations", "1")
    shared = ["--trajectories", f"{a.out}/trajectories", "--evaluations", f"{a.out}/evaluations"]
    for command in (["rescore", *shared], ["report", *shared, "--run", "1", "--out", f"{a.out}/report"], ["select", *shared, "--run", "1", "--out", f"{a.out}/curated"]):
        main(command, spark)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="larkspur", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name, action, **options):
        p = commands.add_parser(name)
        for option, settings in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", **settings)
        p.set_defaults(run_command=action)

    need, pair = {"required": True}, {"trajectories": {"required": True}, "evaluations": {"required": True}, "run": {"default": "latest"}}
    number = {"type": int, "default": None}
    command("runs", show_runs, root=need)
    command("select", select, **pair, out=need, profile={"choices": sorted(PROFILES), "default": "generous"}, holdout={"type": float, "default": 0.0}, max_records=number, max_per_locale=number, stratify_by={"default": "probe_family"}, columns={"default": "full"})
    command("report", report, **pair, out=need, min_n={"type": int, "default": 3})
    command("rescore", rescore, **pair, scorers={"default": ""})
    command("smoke", smoke, out=need)
    a = parser.parse_args(argv)
    a.run_command(spark or _session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
