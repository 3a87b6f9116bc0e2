"""Run manifests: what a run holds, its versions and its evaluation passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import parse_outcome
from ..sources.runs import exists, list_runs, read_json, write_json


#: The kind of a run that holds sampled rows.
SAMPLED = "sampled"


def run_aggregates(df: DataFrame, *, outcome: str = "simulation_outcome") -> DataFrame:
    """(section, key, value): counts by status, failure class, locale and locale:probe, probe variants, prompt and bank versions (the first by id)."""
    o = parse_outcome(F.col(outcome))
    rows = df.select("trajectory_id", "locale", "probe_family", "probe_variant" if "probe_variant" in df.columns else F.lit(None).cast("string").alias("probe_variant"), o.alias("o"))
    count = lambda section, key, where=F.lit(True): rows.where(key.isNotNull() & where).groupBy(key.alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit(section).alias("section"), "key", "value")
    out = count("status_counts", F.col("o.status"))
    out = out.union(count("failure_class_histogram", F.col("o.failure_class")))
    out = out.union(count("trajectories_completed", F.col("locale")))
    cell = F.concat(F.col("locale"), F.lit(":"), F.col("probe_family"))
    out = out.union(count("coverage_per_locale_probe", cell))
    variants = rows.where("probe_variant <> ''").groupBy("probe_family").agg(F.array_join(F.array_sort(F.collect_set("probe_variant")), ",").alias("value"))
    out = out.union(variants.select(F.lit("probe_variants"), "probe_family", "value"))
    prompts = rows.where("o.provenance.scenario_prompt_version is not null and probe_family is not null")
    out = out.union(prompts.groupBy("probe_family").agg(F.min_by("o.provenance.scenario_prompt_version", "trajectory_id").alias("v")).select(F.lit("prompt_versions"), "probe_family", "v"))
    banks = rows.select("trajectory_id", F.explode("o.provenance.bank_version").alias("k", "v"))
    return out.union(banks.groupBy("k").agg(F.min_by("v", "trajectory_id").alias("v")).select(F.lit("bank_versions"), "k", "v"))


def as_dict(aggregates: DataFrame) -> dict[str, dict[str, str]]:
    """The aggregates as sections; their size is that of the run's dimensions."""
    out: dict[str, dict[str, str]] = {}
    for r in aggregates.orderBy("section", "key").toLocalIterator():
        out.setdefault(r.section, {})[r.key] = r.value
    return out


def write_manifest(df: DataFrame, path: str, **extra) -> dict:
    manifest = {"version": 2, **as_dict(run_aggregates(df)), **extra}
    write_json(df.sparkSession, path, manifest)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest, one of the first version brought up to date (its flat counts become status counts)."""
    m = read_json(spark, path)
    if m.get("version", 1) < 2:
        m = {"version": 2, "status_counts": m.get("counts", {}), **{k: v for k, v in m.items() if k not in ("version", "counts")}}
    return m


def record_pass(spark: SparkSession, path: str, entry: dict) -> dict:
    """Append an evaluation pass to the history."""
    m = read_json(spark, path) if exists(spark, path) else {"version": 2, "passes": []}
    m["passes"] = [*m.get("passes", []), entry]
    write_json(spark, path, m)
    return m


def latest_run_where(spark: SparkSession, root: str, keep) -> str | None:
    """The newest run whose record (``_run.json``) meets a condition."""
    for run in reversed(list_runs(spark, root)):
        path = f"{root}/run={run}/_run.json"
        if exists(spark, path) and keep(read_json(spark, path)):
            return run
    return None


def sampled_run_to_resume(spark: SparkSession, root: str) -> str | None:
    """The newest run of sampled rows, which a resumed simulation goes on with; a run without a record,
    made before there were any, counts as one."""
    for run in reversed(list_runs(spark, root)):
        path = f"{root}/run={run}/_run.json"
        if not exists(spark, path) or read_json(spark, path).get("kind") == SAMPLED:
            return run
    return None


def comparison_runs(spark: SparkSession, root: str, wanted: Sequence[str] | None = None, name: str = "_report.json") -> list[str]:
    """Runs with a report, newest first; or the wanted ones in their order, which must all have one."""
    have = [r for r in reversed(list_runs(spark, root)) if exists(spark, f"{root}/run={r}/{name}")]
    if wanted is None:
        return have
    missing = [w for w in wanted if w not in have]
    if missing:
        raise FileNotFoundError(f"no report for runs: {', '.join(missing)}")
    return list(wanted)


def generation_model(df: DataFrame, column: str = "assistant_model") -> str | None:
    """The one model that made all rows; several are an error."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"several generation models: {sorted(found)}")
    return found[0] if found else None
