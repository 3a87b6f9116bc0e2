"""A run at a glance: each row's state, warnings and people, and the states' counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import parse_outcome

OK, WARN, FAIL = "SIM OK", "SIM WARN", "SIM FAIL"
#: What stands for an unknown value.
UNKNOWN = "—"


def is_placeholder(kind: Column) -> Column:
    """Warnings that tell of the content that a simulation ran on, not of the simulation."""
    return F.contains(kind, F.lit("placeholder"))


def _kinds(outcome: Column) -> Column:
    """The kinds of an outcome's warnings, repeats included, without placeholder ones."""
    kinds = F.transform(F.coalesce(outcome["warnings"], F.expr("array()").cast("array<struct<kind:string,turn_idx:int,detail:string>>")), lambda w: w["kind"])
    return F.filter(kinds, lambda k: k.isNotNull() & (k != "") & ~is_placeholder(k))


def warning_chips(outcome: Column) -> Column:
    """Each kind of warning once, in the order of its first, with ``×n`` where it came n times."""
    kinds = _kinds(outcome)
    times = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    return F.transform(F.array_distinct(kinds), lambda k: F.when(times(k) > 1, F.concat(k, F.lit("×"), times(k).cast("string"))).otherwise(k))


def status_kind(outcome: Column, completed: Column) -> Column:
    """An outcome's status; completed with warnings only counts as that if one of them isn't about placeholders. Without a known
    status, whether the conversation was completed and has warnings."""
    warned = F.when(F.size(_kinds(outcome)) > 0, WARN).otherwise(OK)
    known = F.when(outcome["status"] == "failed", FAIL).when(outcome["status"] == "completed_with_warnings", warned).when(outcome["status"] == "ok", OK)
    return F.coalesce(known, F.when(F.coalesce(completed, F.lit(False)), warned).otherwise(FAIL))


def preview_rows(df: DataFrame, *, key: str = "trajectory_id", outcome: str = "simulation_outcome", completed: str = "conversation_status") -> DataFrame:
    """(key, status, warnings, probe, style, turns, tools, locale, age, sex): a line for each row.

    style is ``behaviour/style`` where a row has both halves (``user_behavior``, ``interaction_style``). Columns that ``df``
    lacks, and nulls, are shown as a dash, counts as 0.
    """
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    shown = lambda c: F.coalesce(F.nullif(F.trim(have(c)), F.lit("")), F.lit(UNKNOWN))
    rows = df.withColumn("_o", parse_outcome(F.col(outcome)))
    o = F.col("_o")
    style = F.when(have("user_behavior").isNotNull() & have("interaction_style").isNotNull(), F.concat_ws("/", have("user_behavior"), have("interaction_style"))).otherwise(UNKNOWN)
    done = F.col(completed) if completed in df.columns else F.lit(False)
    return rows.select(
        key, status_kind(o, done).alias("status"), F.array_join(warning_chips(o), ", ").alias("warnings"), shown("probe_type").alias("probe"), style.alias("style"),
        F.coalesce(have("num_turns").try_cast("int"), F.lit(0)).alias("turns"), F.coalesce(have("num_tool_calls").try_cast("int"), F.lit(0)).alias("tools"),
        shown("locale").alias("locale"), shown("age").alias("age"), shown("sex").alias("sex"),
    )


def preview_counts(rows: DataFrame) -> DataFrame:
    """(n_rows, n_ok, n_warn, n_fail) of ``preview_rows``."""
    return rows.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("status") == s).alias(n) for s, n in ((OK, "n_ok"), (WARN, "n_warn"), (FAIL, "n_fail"))])


def warning_counts(df: DataFrame, *, outcome: str = "simulation_outcome") -> DataFrame:
    """(kind, n_rows, n): the rows that a kind of warning came in, and how often, without placeholder ones."""
    kinds = df.select(_kinds(parse_outcome(F.col(outcome))).alias("k"))
    per_row = kinds.select(F.explode(F.transform(F.array_distinct("k"), lambda x: F.struct(x.alias("kind"), F.size(F.filter("k", lambda y: y == x)).alias("n")))).alias("w"))
    return per_row.groupBy("w.kind").agg(F.count("*").alias("n_rows"), F.sum("w.n").alias("n"))
