"""Capability x locale x run cubes, their rollups and the Pareto frontier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEASURED = ("ready", "blocked")
LEFT_OUT = ("simulation_reliability",)


def cube(cells: DataFrame, runs: DataFrame, dims: Sequence[str] = ("capability", "locale"), run: str = "run_id", state: str = "state") -> DataFrame:
    """Every run against every value of each dimension that any run has; what a run lacks is ``missing``."""
    grid = runs.select(run).distinct()
    for d in dims:
        grid = grid.crossJoin(cells.select(d).distinct())  # a few values each: the cube itself is the result
    return grid.join(cells, [run, *dims], "left").withColumn(state, F.coalesce(F.col(state), F.lit("missing")))


def rollup_runs(cells: DataFrame, run: str = "run_id", score: str = "score") -> DataFrame:
    """Per run: cells by state, and the mean over locales of each locale's mean measured score."""
    eligible = ~F.col("capability").isin(*LEFT_OUT)
    measured = eligible & F.col("state").isin(*MEASURED) & F.col(score).isNotNull()
    by_locale = cells.groupBy(run, "locale").agg(
        F.count("*").alias("n_cells"),
        F.count_if(eligible).alias("n_eligible"),
        F.count_if(measured).alias("n_measured"),
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("ready", "blocked", "missing", "insufficient_evidence")],
        F.avg(F.when(measured, F.col(score))).alias("locale_mean"),
    )
    counts = [c for c in by_locale.columns if c.startswith("n_")]
    out = by_locale.groupBy(run).agg(*[F.sum(c).alias(c) for c in counts], F.avg("locale_mean").alias("mean_score"))
    return out.withColumns({f"pct_{s}": F.col(f"n_{s}") / F.col("n_cells") for s in ("ready", "blocked", "missing", "insufficient_evidence")})


def pareto(df: DataFrame, score: str, cost: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows that no other row beats by a strictly higher score at a strictly lower cost; unmeasured rows are none.

    A row is beaten where the best score among all strictly lower costs is above
    its own, so one sorted pass replaces the comparison of all pairs: costs are
    reduced to their best score first, and running maxima are taken over these.
    """
    rows = df.where(F.col(score).isNotNull() & (F.col(cost) > 0))
    best = rows.groupBy(*within, cost).agg(F.max(score).alias("_top"))
    order = Window.partitionBy(*within).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_cheaper", F.max("_top").over(order)).drop("_top")
    return rows.join(best, [*within, cost]).where(F.col("_cheaper").isNull() | (F.col("_cheaper") <= F.col(score))).select(*df.columns)


def disambiguate(df: DataFrame, label: str, run: str) -> DataFrame:
    """Labels that several runs share get the run appended."""
    n = F.count("*").over(Window.partitionBy(label))
    return df.withColumn(label, F.when(n > 1, F.concat(F.col(label), F.lit(" (run="), F.col(run).cast("string"), F.lit(")"))).otherwise(F.col(label)))


def comparison_warnings(runs: DataFrame, *, rows: str = "n_trajectories") -> DataFrame:
    """(warning): what keeps runs from being compared like with like."""
    checks = {
        "mixed sample modes": F.countDistinct("sample_mode") > 1,
        "mixed prompt versions": F.countDistinct("prompt_version") > 1,
        "row counts differ by over a tenth": F.max(rows) - F.min(rows) > 0.1 * F.max(rows),
    }
    flags = runs.agg(*[c.alias(k) for k, c in checks.items()])
    return flags.unpivot([], list(checks), "warning", "found").where("found").select("warning")


def cleared_counts(cells: DataFrame, by: Sequence[str] = (), run: str = "run_id") -> DataFrame:
    """(run, by, n_ready, n_eligible): ready cells of all that count. By capability every cell counts, else not those of ``LEFT_OUT``."""
    rows = cells if "capability" in by else cells.where(~F.col("capability").isin(*LEFT_OUT))
    return rows.groupBy(run, *by).agg(F.count_if(F.col("state") == "ready").alias("n_ready"), F.count("*").alias("n_eligible"))


def locale_means(cells: DataFrame, run: str = "run_id", score: str = "score") -> DataFrame:
    """(run, locale, mean_score) over the measured cells; null where a run has none in a locale."""
    measured = F.col("state").isin(*MEASURED)
    return cells.where(~F.col("capability").isin(*LEFT_OUT)).groupBy(run, "locale").agg(F.avg(F.when(measured, F.col(score))).alias("mean_score"))


def overall_cells(cells: DataFrame, run: str = "run_id", score: str = "score") -> DataFrame:
    """The cells over all locales: (run, capability, n_locales, n_failed, mean_score, state), from measured ones with a score.

    ``cells`` hold threshold and failed_axes (array). The mean of the scores is blocked where any locale failed a must-pass
    axis or where it is under the threshold, else ready; pairs of run and capability without a measured cell have no row.
    """
    failed = F.coalesce(F.size("failed_axes"), F.lit(0)) > 0
    measured = cells.where(F.col("state").isin(*MEASURED) & F.col(score).isNotNull())
    out = measured.groupBy(run, "capability").agg(F.count("*").alias("n_locales"), F.count_if(failed).alias("n_failed"), F.avg(score).alias("mean_score"), F.max("threshold").alias("_limit"))
    state = F.when((F.col("n_failed") > 0) | (F.col("mean_score") < F.col("_limit")), "blocked").otherwise("ready")
    return out.withColumn("state", state).drop("_limit")


def leaderboard(cells: DataFrame, run: str = "run_id", score: str = "score") -> DataFrame:
    """(run, n_ready, n_eligible, cleared, mean_score, place): runs by their share of ready cells, then mean score, then id."""
    totals = cleared_counts(cells, run=run).join(rollup_runs(cells, run, score).select(run, "mean_score"), run)
    cleared = F.col("n_ready") / F.col("n_eligible")
    # one row for each run
    order = Window.orderBy(cleared.desc(), F.col("mean_score").desc_nulls_last(), F.col(run))
    return totals.withColumns({"cleared": cleared, "place": F.row_number().over(order)})


def heatmap(cells: DataFrame, run: str = "run_id") -> DataFrame:
    """(capability, locale, n_ready, n_measured, n_runs): how many runs clear each cell."""
    return cells.groupBy("capability", "locale").agg(
        F.count_if(F.col("state") == "ready").alias("n_ready"), F.count_if(F.col("state").isin(*MEASURED)).alias("n_measured"), F.countDistinct(run).alias("n_runs")
    )
