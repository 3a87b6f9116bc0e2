"""Judges: their families, what a cell holds of their verdicts, and which rows need them again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import parse_cell, scorer_state

# Parts of model names, then of provider paths, by judge family.
FAMILIES = {
    "gpt": "openai", "o3": "openai", "o4": "openai", "claude": "anthropic", "gemini": "gemini", "gemma": "gemini", "qwen": "qwen", "llama": "llama",
    "mistral": "mistral", "deepseek": "deepseek", "openai/": "openai", "anthropic/": "anthropic", "alibaba/": "qwen", "meta/": "llama", "meta-llama/": "llama", "google/": "gemini",
}


def family(model: Column, hints: Mapping[str, str] = FAMILIES) -> Column:
    """The first hint that a model name contains; ``other`` without one."""
    name, out = F.lower(model), F.lit("other")
    for hint, value in reversed(list(hints.items())):
        out = F.when(F.contains(name, F.lit(hint)), value).otherwise(out)
    return out


def check_diversity(families: Sequence[str], least: int = 2) -> None:
    """Two or more judges must be of so many families, and not all unknown ones."""
    if len(families) < 2:
        return
    if set(families) == {"other"}:
        raise ValueError("no judge's family is known")
    if len(set(families)) < least:
        raise ValueError(f"judges of {least} families are needed, these are {sorted(set(families))}")


def verdict(cell: Column) -> Column:
    """``scored``, ``missing`` (axes but no score) or ``not_applicable``; a cell carried over by an equal envelope counts by what it holds."""
    c = parse_cell(cell)
    skipped = F.coalesce(c["skipped"], F.lit(False)) & ~F.coalesce(c["skipped_reason"] == "envelope_match", F.lit(False))
    none = c.isNull() | skipped | (F.coalesce(F.size(c["axes"]), F.lit(0)) < 1)
    scored = F.exists(F.map_values(c["axes"]), lambda by: F.exists(F.map_values(by), lambda j: j["score"].isNotNull()))
    return F.when(none, "not_applicable").when(scored, "scored").otherwise("missing")


def needs_judging(cell: Column, envelope: Column | None = None) -> Column:
    """Rows whose verdict is missing, one of whose scorers failed, or that another envelope judged."""
    c = parse_cell(cell)
    failed = F.exists(F.map_values(c["scorers"]), lambda b: scorer_state(b) == "error")
    again = c.isNull() | (verdict(cell) == "missing") | F.coalesce(failed, F.lit(False))
    if envelope is not None:
        again = again | ~F.to_json(c["envelope"]).eqNullSafe(envelope)
    return again


def verdict_counts(df: DataFrame, cell: str = "assistant_eval") -> DataFrame:
    return df.groupBy(verdict(F.col(cell)).alias("verdict")).agg(F.count("*").alias("n"))


def self_judging(runs: DataFrame, judges: DataFrame) -> DataFrame:
    """(run_id, model) where a judge (run_id, judge_model) is the model that it judges (run_id, assistant_model)."""
    return runs.join(judges, "run_id").where(F.lower("assistant_model") == F.lower("judge_model")).select("run_id", F.col("assistant_model").alias("model")).distinct()


def axis_columns(df: DataFrame, axes: Sequence[str], *, cell: str = "eval_scores", keep: Sequence[str] = ("locale", "probe_type")) -> DataFrame:
    """``score_<axis>`` columns from a JSON object of {axis: {score}}; rows without an object are left out."""
    parsed = F.from_json(F.when(F.trim(F.col(cell)).startswith("{"), F.col(cell)), "map<string,struct<score:double>>")
    rows = df.withColumn("_s", parsed).where("_s is not null")
    strata = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) if k in df.columns else F.lit("").alias(k) for k in keep]
    return rows.select(*strata, *[F.element_at("_s", a)["score"].alias(f"score_{a}") for a in axes])


def content_tally(df: DataFrame, by: Sequence[str], *, warnings: str = "warning_kinds") -> DataFrame:
    """Rows on placeholder content, on machine translation and on neither, and whether all of a group rest on such content.

    ``warnings`` is an array of the row's warning kinds.
    """
    kinds = F.coalesce(F.col(warnings), F.expr("array()").cast("array<string>"))
    placeholder = F.exists(kinds, lambda k: F.contains(k, F.lit("placeholder")))
    translated = F.array_contains(kinds, "used_machine_translation")
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(placeholder).alias("n_placeholder"), F.count_if(translated).alias("n_machine_translated"), F.count_if(~(placeholder | translated)).alias("n_unflagged"))
    return out.withColumn("unreviewed", F.col("n_unflagged") == 0)


def capability_coverage(needed: DataFrame, scorers: DataFrame) -> DataFrame:
    """(capability, scorer) that a capability needs and no registered scorer gives."""
    return needed.where("scorer is not null").join(scorers, "scorer", "left_anti").select("capability", "scorer").distinct()


def item_means(entries: DataFrame, key: str, axes: Sequence[str], *, tag: str = "item_id", scores: str = "scores") -> DataFrame:
    """(key, axis, n, score, lowest): a trajectory's mean per axis over its facts or categories, three digits, and the items
    with the lowest score, sorted.

    ``scores`` maps an axis to its score. Items without a score on an axis don't count; without any the score is null.
    """
    rows = entries.select(key, F.col(tag).alias("_tag"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.element_at(scores, a).cast("double").alias("s")) for a in axes])).alias("x"))
    rows = rows.select(key, "_tag", "x.axis", "x.s")
    made = rows.groupBy(key, "axis").agg(
        F.count("s").alias("n"), F.round(F.avg("s"), 3).alias("score"), F.min("s").alias("_low"), F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "_tag"))).alias("_all")
    )
    lowest = F.array_sort(F.transform(F.filter("_all", lambda x: x["s"] == F.col("_low")), lambda x: x["_tag"]))
    return made.select(key, "axis", "n", "score", lowest.alias("lowest"))


def item_reasons(entries: DataFrame, key: str, axes: Sequence[str], *, tag: str = "item_id", place: str = "position", scores: str = "scores", unit: tuple[str, str] = ("fact", "facts"), quoted: int = 2) -> DataFrame:
    """(key, axis, n, score, reasoning): a trajectory's mean per axis over its items, three digits, and why.

    ``scores`` maps an axis to (score, reasoning). One item's own reason is the reason; of several, the ``quoted`` lowest that
    have one are quoted with item and score, in the items' order where equal. Without any score the score is null. A
    trajectory's items are few, so they are listed as a whole.
    """
    number = lambda s: F.when(s == F.floor(s), F.floor(s).cast("string")).otherwise(F.format_string("%.1f", s))
    text = lambda c: F.coalesce(c, F.lit(""))
    each = F.array(*[F.struct(F.lit(a).alias("axis"), F.element_at(scores, a).alias("s")) for a in axes])
    rows = entries.select(key, F.col(place).alias("_p"), text(F.col(tag)).alias("_t"), F.explode(each).alias("x"))
    score = F.nanvl(F.col("x.s.score").cast("double"), F.lit(None).cast("double"))
    rows = rows.select(key, "x.axis", F.when(score.isNotNull(), F.struct(score.alias("s"), (text(F.col("x.s.reasoning")) == "").alias("none"), F.col("_p").alias("p"), F.col("_t").alias("t"), text(F.col("x.s.reasoning")).alias("r"))).alias("e"))
    made = rows.groupBy(key, "axis").agg(F.count("e").alias("n"), F.round(F.avg("e.s"), 3).alias("score"), F.array_sort(F.collect_list("e")).alias("_e"))
    only = F.get("_e", 0)
    tagged = only["t"] != ""
    alone = F.when(only["r"] != "", F.when(tagged, F.concat(F.lit("["), only["t"], F.lit("] "), only["r"])).otherwise(only["r"])).otherwise(
        F.concat(F.lit("score="), number(only["s"]), F.when(tagged, F.concat(F.lit(f" on {unit[0]} '"), only["t"], F.lit("'"))).otherwise(""))
    )
    low = F.slice(F.filter("_e", lambda e: ~e["none"]), 1, quoted)
    bullets = F.array_join(F.transform(low, lambda e: F.concat(F.lit('\n• "'), F.when(e["t"] == "", "?").otherwise(e["t"]), F.lit('" (score='), number(e["s"]), F.lit("): "), e["r"])), "")
    mean = F.concat(F.lit("Mean "), F.col("score").cast("string"), F.lit(" across "), F.col("n").cast("string"), F.lit(f" {unit[1]}."))
    several = F.when(F.size(low) > 0, F.concat(mean, F.lit(" Lowest scoring:"), bullets)).otherwise(mean)
    reason = F.when(F.col("n") == 0, f"no per-{unit[0]} scores").when(F.col("n") == 1, alone).otherwise(several)
    return made.select(key, "axis", "n", "score", reason.alias("reasoning"))


def scorecard(docs: DataFrame, axes: Sequence[str], *, key: str = "id", floor: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(per document: key, axes as numbers, is_low; one row: mean_<axis>, n_docs, n_low). Text that isn't a number has no score."""
    per_doc = docs.select(key, *[F.col(a).try_cast("double").alias(a) for a in axes])
    low = F.lit(False)
    for a in axes:
        low = low | F.coalesce(F.col(a) < floor, F.lit(False))
    per_doc = per_doc.withColumn("is_low", low)
    total = per_doc.agg(*[F.avg(a).alias(f"mean_{a}") for a in axes], F.count("*").alias("n_docs"), F.count_if("is_low").alias("n_low"))
    return per_doc, total


def usable(rows: DataFrame, scores: Sequence[str], floor: float = 3.0) -> DataFrame:
    """Rows of which every score that there is reaches the floor; rows without any score are not usable."""
    have = F.coalesce(*[F.col(c) for c in scores]).isNotNull()
    for c in scores:
        have = have & (F.col(c).isNull() | (F.col(c) >= floor))
    return rows.where(have)


def choose_axes(axes: DataFrame, probe: str, names: Sequence[str] | None = None) -> DataFrame:
    """Of the axis table (axis, category, probe_families) those that apply to a probe, and are named if names are given.

    A null or empty list of probe families applies to all; a name that applies nowhere is an error.
    """
    fits = F.col("probe_families").isNull() | (F.size("probe_families") == 0) | F.array_contains("probe_families", F.lit(probe))
    chosen = axes.where(fits)
    if names is None:
        return chosen
    known = {r[0] for r in chosen.where(F.col("axis").isin(*names)).select("axis").distinct().collect()}
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"axes that {probe} doesn't have: {', '.join(missing)}")
    return chosen.where(F.col("axis").isin(*names))


# The axes that guard, and those of quality; all others (role adherence too) are outcomes of a probe.
GUARDRAIL_AXES = ("safety", "cultural_sensitivity", "language_appropriateness")
QUALITY_AXES = ("helpfulness", "accuracy", "coherence", "response_conciseness", "personalization", "pedagogical_quality", "internal_architecture_leaking", "tool_use_correctness")


def axis_category(axis: Column, guardrail: Sequence[str] = GUARDRAIL_AXES, quality: Sequence[str] = QUALITY_AXES) -> Column:
    """``guardrail``, ``quality`` or ``probe_outcome``, by membership."""
    return F.when(axis.isin(*guardrail), "guardrail").when(axis.isin(*quality), "quality").when(axis.isNotNull(), "probe_outcome")
