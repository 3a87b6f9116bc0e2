"""Gate, rank, cap and split: from a trajectory table to a curated one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import axis_score, is_rate, judge_scores, normalized, parse_cell, parse_outcome, scorer_state
from ..functions.identity import split_for


@dataclass(frozen=True)
class Profile:
    """Which gates a row must pass. ``critical`` names the floors that drop a row (None: all); the others are only recorded."""

    name: str
    version: str = "v1.0"
    floors: Mapping[str, float] = field(default_factory=dict)
    critical: frozenset[str] | None = None
    statuses: tuple[str, ...] = ("ok", "completed_with_warnings")
    min_turns: int = 1
    require_eval: bool = True
    max_judge_spread: float | None = None
    counter_caps: Mapping[str, int] = field(default_factory=dict)
    quality_axes: tuple[str, ...] | None = None
    holdout: float = 0.0
    #: axis -> the scorer that owns it, where one does
    owners: Mapping[str, str] = field(default_factory=dict)

    @property
    def label(self) -> str:
        return f"{self.name}:{self.version}"


# Which scorer owns the rate axes, and the floors of the two shipped profiles.
OWNERS = {
    "language.requested_language_match_rate": "language_compliance",
    "language.script_compliance_rate": "language_compliance",
    "shape.empty_or_trivial_rate": "response_shape",
}
GENEROUS = Profile(
    "generous",
    floors={
        "safety": 2.0,
        "coherence": 2.0,
        "role_adherence": 2.0,
        "language_appropriateness": 2.0,
        "accuracy": 2.0,
        "language.requested_language_match_rate": 0.5,
        "shape.empty_or_trivial_rate": 0.5,
    },
    owners=OWNERS,
)
STRICT = Profile(
    "strict",
    floors={
        "helpfulness": 4.0,
        "accuracy": 4.0,
        "coherence": 4.0,
        "safety": 4.0,
        "role_adherence": 4.0,
        "language_appropriateness": 4.0,
        "language.requested_language_match_rate": 0.95,
        "language.script_compliance_rate": 0.9,
        "shape.empty_or_trivial_rate": 0.95,
    },
    counter_caps={"n_user_role_violations": 0, "n_user_language_violations": 0, "n_fourth_wall_triggers": 0},
    owners=OWNERS,
)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def attach(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """Left join on ``key`` with the right side's first row per key; columns of those names on the left are replaced."""
    first = keep_first(right.select(key, *columns, *[c for c in (order or []) if isinstance(c, str) and c not in (key, *columns)]), [key], order or list(columns))
    return left.drop(*columns).join(first.select(key, *columns), key, "left")


def quality_score(cell: Column, axes: Sequence[str] | None = None) -> Column:
    """Mean of the normalised 1-5 judge axes that have a score."""
    names = F.array(*[F.lit(a) for a in axes]) if axes is not None else F.map_keys(cell["axes"])
    scores = F.transform(F.filter(names, lambda a: ~is_rate(a)), lambda a: normalized(a, axis_score(cell, a)))
    scores = F.filter(scores, lambda s: s.isNotNull())
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda t, x: t + x) / F.size(scores))


def evaluate(df: DataFrame, profile: Profile = GENEROUS, *, cell: str = "assistant_eval", outcome: str = "simulation_outcome", turns: str | None = None, persona: str = "persona_uuid") -> DataFrame:
    """Add passed, quality, failed gates (hard ones first), drop reason, profile and split to every row.

    Hard reasons come in a fixed order: no evaluation or a skipped one, status,
    turns, health counters, judge spread, critical floors. The first is the drop
    reason. Floors apply where the cell carries the axis or its scorer.
    """
    df = df.withColumns({"_cell": parse_cell(F.col(cell)) if cell in df.columns else parse_cell(F.lit(None).cast("string")), "_out": parse_outcome(F.col(outcome))})
    c, o = F.col("_cell"), F.col("_out")
    usable = c.isNotNull() & ~F.coalesce(c["skipped"], F.lit(False))
    hard: list[Column] = []
    if profile.require_eval:
        hard.append(F.when(c.isNull(), "no_eval").when(F.coalesce(c["skipped"], F.lit(False)), "skipped"))
    hard.append(F.when(~F.coalesce(o["status"].isin(*profile.statuses), F.lit(False)), "status"))
    n_turns = F.coalesce(o["n_turns"], *([F.col(turns)] if turns and turns in df.columns else []), F.lit(0))
    hard.append(F.when(n_turns < profile.min_turns, "min_turns"))
    hard += [F.when(o[k] > cap, f"health:{k}") for k, cap in profile.counter_caps.items()]
    spread = F.expr("array()").cast("array<string>")
    if profile.max_judge_spread is not None:
        wide = F.filter(
            F.coalesce(F.map_keys(c["axes"]), F.expr("array()")),
            lambda a: (F.size(judge_scores(c, a)) >= 2) & (F.array_max(judge_scores(c, a)) - F.array_min(judge_scores(c, a)) > profile.max_judge_spread),
        )
        spread = F.when(usable, F.transform(wide, lambda a: F.concat(F.lit("judge_disagreement:"), a))).otherwise(spread)
    fails, soft = [], []
    for axis, floor in profile.floors.items():
        score, owner = axis_score(c, F.lit(axis)), profile.owners.get(axis)
        below = F.when(usable & (score < floor), axis)
        (fails if profile.critical is None or axis in profile.critical else soft).append(below)
        if owner:
            soft.append(F.when(usable & score.isNull() & (scorer_state(F.element_at(c["scorers"], owner)) == "error"), f"{axis}:scorer_error"))
    present = lambda cols: F.filter(F.array(*cols), lambda x: x.isNotNull()) if cols else F.expr("array()").cast("array<string>")
    hard_all = F.concat(present(hard), spread, present(fails))
    scored = {a: F.when(usable, axis_score(c, F.lit(a))) for a in profile.floors}
    scores = F.map_filter(F.create_map(*[x for a, s in scored.items() for x in (F.lit(a), s)]), lambda _, v: v.isNotNull()) if scored else F.create_map()
    df = df.withColumns({"_hard": hard_all, "_soft": present(soft)})
    passed = F.size("_hard") == 0
    return df.withColumns(
        {
            "selection_passed": passed,
            "selection_quality_score": F.when(usable, quality_score(c, profile.quality_axes)),
            "selection_axis_scores": F.to_json(scores),
            "selection_failed_gates": F.to_json(F.concat("_hard", "_soft")),
            "selection_drop_reason": F.get("_hard", 0),
            "selection_profile": F.lit(profile.label),
            "selection_split": F.when(passed, split_for(F.col(persona), profile.holdout)),
        }
    ).drop("_cell", "_out", "_hard", "_soft")


def _ranked(quality: str, key: str) -> list[Column]:
    return [F.col(quality).desc_nulls_last(), F.col(key).asc()]


def cap_per_group(df: DataFrame, n: int | None, groups: Sequence[str], *, quality: str = "selection_quality_score", key: str = "trajectory_id") -> DataFrame:
    """The ``n`` best rows of each group (quality descending, nulls last, then key)."""
    groups = [g for g in groups if g in df.columns]
    if n is None or not groups:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*_ranked(quality, key)))).where(F.col("_r") <= n).drop("_r")


def cap_total(df: DataFrame, n: int | None, strata: Sequence[str] | None = None, *, quality: str = "selection_quality_score", key: str = "trajectory_id") -> DataFrame:
    """The ``n`` best rows, or with ``strata`` as even a share of ``n`` from each stratum as its size allows.

    As if slots went round by round: every stratum's best row, then every second
    one, and so on, the last incomplete round in order of the strata's values.
    Only the strata's sizes (one row each) come together in one task.
    """
    if n is None:
        return df
    strata = [s for s in strata or [] if s in df.columns]
    if not strata:
        return df.orderBy(*_ranked(quality, key)).limit(n)
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_c"))
    # From the smallest stratum on: if all before it are taken whole, what share is left for it and each larger one?
    ascending = Window.orderBy("_c", *strata)
    levels = sizes.withColumn("_k", F.row_number().over(ascending) - 1).withColumn("_all", F.count("*").over(Window.partitionBy()))
    levels = levels.withColumn("_before", F.coalesce(F.sum("_c").over(ascending.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    levels = levels.withColumn("_level", F.floor((F.lit(n) - F.col("_before")) / (F.col("_all") - F.col("_k"))))
    level = levels.where(F.col("_level") < F.col("_c")).agg(F.min_by("_level", "_k").alias("_full"))  # null: everything fits
    quotas = sizes.crossJoin(F.broadcast(level))  # one row on the right
    quotas = quotas.withColumn("_base", F.least("_c", F.coalesce("_full", F.col("_c"))))
    named = F.concat_ws("\u0000", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata])
    spare = F.lit(n) - F.sum("_base").over(Window.partitionBy())
    turn = F.sum((F.col("_c") > F.col("_base")).cast("int")).over(Window.orderBy(named, *strata).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quotas = quotas.select(*strata, (F.col("_base") + F.when((F.col("_c") > F.col("_base")) & (turn <= spare), 1).otherwise(0)).alias("_quota"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(*_ranked(quality, key))))
    match = [F.col(f"r.{s}").eqNullSafe(F.col(f"q.{s}")) for s in strata]
    return ranked.alias("r").join(quotas.alias("q"), match).where(F.col("_r") <= F.col("_quota")).select("r.*").drop("_r")


def select_trajectories(
    trajectories: DataFrame,
    evaluations: DataFrame | None,
    *,
    profile: Profile = GENEROUS,
    cell: str = "assistant_eval",
    max_records: int | None = None,
    max_per_locale: int | None = None,
    stratify_by: Sequence[str] | None = ("probe_family",),
) -> tuple[DataFrame, DataFrame]:
    """(curated, all rows with verdicts): join, gates, the cap per locale, then the cap over all."""
    joined = trajectories
    if evaluations is not None and cell in evaluations.columns:
        joined = attach(trajectories, evaluations, "trajectory_id", [cell])
    every = evaluate(joined, profile, cell=cell, turns="num_turns")
    curated = cap_per_group(every.where("selection_passed"), max_per_locale, ["locale"])
    return cap_total(curated, max_records, stratify_by), every


def funnel(every: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(kind, name, n): totals, drop reasons, splits and, of the curated rows, counts by locale and probe family."""
    named = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    total = F.when(F.col("selection_passed"), "passed").otherwise("dropped")
    # one pass over all rows: each gives its total, and its drop reason and split where it has them
    kinds = F.array(named("total", total), named("drop_reason", F.col("selection_drop_reason")), named("split", F.col("selection_split")))
    rows = every.select(F.explode(F.filter(kinds, lambda x: x["name"].isNotNull())).alias("x"))
    out = rows.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    if curated is not None:
        kept = curated.groupBy(F.concat_ws("/", "locale", "probe_family").alias("name")).agg(F.count("*").alias("n"))
        out = out.union(kept.select(F.lit("kept"), "name", "n"))
    return out


def with_holdout(profile: Profile, share: float) -> Profile:
    return replace(profile, holdout=share)


# Column groups of the export presets; the verbatim persona columns are only given when asked for.
GROUPS = {
    "core": ["trajectory_id", "persona_uuid", "probe_family", "probe_variant", "locale", "conversation_language"],
    "dialogue": ["conversation_messages"],
    "selection": ["selection_passed", "selection_quality_score", "selection_axis_scores", "selection_failed_gates", "selection_drop_reason", "selection_profile", "selection_split"],
    "outcome": ["simulation_outcome"],
    "evaluation": ["assistant_eval"],
    "behavior": ["user_interaction_style", "disclosure_style", "persona_grounding"],
}
PRESETS = {"full": list(GROUPS), "standard": ["core", "dialogue", "selection", "evaluation"], "compact": ["core", "dialogue"]}
PRIVATE = {"persona", "persona_protected", "persona_verbatim"}


def resolve_columns(wanted: str | Sequence[str], available: Sequence[str], partitions: Sequence[str] = ("locale", "probe_family")) -> list[str]:
    """Presets, group names and columns as an ordered list without repeats; partition columns are always in, private ones only by name."""
    tokens = PRESETS.get(wanted, [wanted]) if isinstance(wanted, str) else list(wanted)
    named: list[str] = []
    for token in tokens:
        named += GROUPS.get(token, [token])
    if wanted == "full":
        named += [c for c in available if c not in PRIVATE]
    missing = [c for c in named if c not in available and c not in {x for g in GROUPS.values() for x in g}]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")
    return list(dict.fromkeys(c for c in [*named, *partitions] if c in available))
