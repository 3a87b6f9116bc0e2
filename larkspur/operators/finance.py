"""Finance episodes: what a persona is like as a customer, and the task instance that it gets.

Everything is drawn by hashes of the persona and the seed. Tasks are picked by
``picks.pick``, so people meet groups of tasks, not tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import hash_fraction
from ..functions.messages import fill_slots, sampled_params
from ..functions.persona import education_ordinal
from .picks import pick

# Parts of occupations that work with money, and what makes a type of institution likelier for whom.
MONEY_WORK = "financ,account,cpa,auditor,analyst,econom,actuar,invest,banker,bank ,trader,trading,portfolio,tax ,wealth,treasur,underwrit,broker".split(",")
AGES = ((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64"))
BOOSTS = {"senior": {"retirement_provider": 1.5, "wealth_manager": 0.75}, "middle": {"retirement_provider": 0.5}, "young": {"brokerage": 0.5}, "expert": {"brokerage": 1.0, "wealth_manager": 1.0}, "novice": {"bank": 0.5}}

VERIFIABLE, DYNAMIC = "verifiable", "dynamic"
NO_TAGS = "array<string>"


def works_with_money(occupation: Column) -> Column:
    name = F.lower(F.coalesce(occupation, F.lit("")))
    out = F.lit(False)
    for part in MONEY_WORK:
        out = out | F.contains(name, F.lit(part))
    return out


def literacy(education: Column, occupation: Column) -> Column:
    """low, medium or high: the education's ordinal, with 0.3 more for work with money, at most 1."""
    score = F.least(education_ordinal(education) + F.when(works_with_money(occupation), 0.3).otherwise(0.0), F.lit(1.0))
    return F.when(score >= 0.7, "high").when(score < 0.35, "low").otherwise("medium")


def customer_tags(age: Column, region: Column, occupation: Column, level: Column) -> Column:
    """age, region, occupation-family and financial-literacy tags, those that are known."""
    a = age.try_cast("int")
    years = F.when(a.isNull(), None)
    for below, name in AGES:
        years = years.when(a < below, f"age:{name}")
    slug = lambda c, p: F.when(F.trim(c) != "", F.concat(F.lit(p), F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))))
    return F.filter(F.array(years.otherwise("age:65+"), slug(region, "region:"), slug(occupation, "occupation-family:"), F.concat(F.lit("financial-literacy:"), level)), lambda t: t.isNotNull())


def type_weights(age: Column, occupation: Column, level: Column) -> Column:
    """Institution types that are likelier for a person, by weight; others weigh 1."""
    a = age.try_cast("int")
    groups = {"senior": a >= 55, "middle": (a >= 35) & (a < 55), "young": a < 35, "expert": (level == "high") | works_with_money(occupation), "novice": level == "low"}
    names = sorted({t for b in BOOSTS.values() for t in b})
    more = lambda t: sum((F.when(F.coalesce(groups[g], F.lit(False)), b[t]).otherwise(0.0) for g, b in BOOSTS.items() if t in b), F.lit(1.0))
    return F.create_map(*[x for t in names for x in (F.lit(t), more(t))])


def picked_tier(key: Column, mix: float, seed: int = 0) -> Column:
    """``dynamic`` with probability ``mix``, else ``verifiable``."""
    return F.when(hash_fraction(key, F.lit("tier"), seed=seed) < mix, DYNAMIC).otherwise(VERIFIABLE)


def _drawn(key: Column, salt: str, values: Column, weights: Column, seed: int) -> Column:
    """The value that a draw falls on, by the weights beside it."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    at = hash_fraction(key, F.lit(salt), seed=seed) * total
    step = lambda s, i: F.when(s["i"].isNotNull(), s).when((s["u"] < F.get(weights, i)) | (i == F.size(weights) - 1), F.struct(s["u"].alias("u"), i.alias("i"))).otherwise(F.struct((s["u"] - F.get(weights, i)).alias("u"), F.lit(None).cast("int").alias("i")))
    fell = F.aggregate(F.sequence(F.lit(0), F.size(weights) - 1), F.struct(at.alias("u"), F.lit(None).cast("int").alias("i")), step)
    return F.when(F.size(values) > 0, F.get(values, fell["i"]))


def instances(people: DataFrame, templates: DataFrame, categories: DataFrame | None = None, *, mix: float = 0.0, seed: int = 0) -> DataFrame:
    """(persona_uuid, tier, institution_id, institution_type, template_id, opening, params, account_state, gold_documents,
    gold_tools, state_deltas, category_id, invitation): one task for each person.

    ``people``: persona_uuid, age, region, occupation, education_level. ``templates``: institution_id, institution_type,
    template_id, tier, tags, openings, param_space (map of arrays), account_state and state_deltas (JSON with ``{{slot}}``
    in strings), gold_documents, gold_tools. ``categories``: institution_type, category_id, invitation, affinities.

    A verifiable instance has a template that fits the person's tags, else any; its slots are filled alike in the opening,
    the account and the gold changes. A dynamic one has an institution, its type weighted by the person, and a category
    of that type, one weight more for each of the person's tags that it is affine to. Who would be dynamic but has no
    institution with categories gets a verifiable instance; without any such template the fields are null.
    """
    a, work = F.col("age"), F.col("occupation")
    rows = people.select("persona_uuid", "age", "region", "occupation", literacy(F.col("education_level"), work).alias("literacy"))
    rows = rows.withColumns({"tags": customer_tags(a, F.col("region"), work, F.col("literacy")), "weights": type_weights(a, work, F.col("literacy")), "tier": picked_tier(F.col("persona_uuid"), mix if categories is not None else 0.0, seed)})
    rows = rows.select("persona_uuid", "tags", "weights", "tier")
    key = F.col("persona_uuid")

    dynamic = None
    if categories is not None:
        # institutions that some template fits come before others
        fits = templates.select("institution_id", "institution_type", F.col("tags").alias("asks")).distinct()
        offered = fits.groupBy("institution_id", "institution_type", F.array_sort(F.coalesce("asks", F.expr("array()").cast(NO_TAGS))).alias("asks")).agg(F.lit(1)).select("institution_id", "institution_type", "asks")
        chosen = pick(rows.where(F.col("tier") == DYNAMIC), offered, key="persona_uuid", task="institution_id", asks="asks", kind="institution_type", weights="weights", seed=seed, salt="institution")
        chosen = chosen.where("institution_id is not null").select("persona_uuid", "institution_id").join(templates.select("institution_id", "institution_type").distinct(), "institution_id")
        listed = categories.groupBy("institution_type").agg(F.array_sort(F.collect_list(F.struct("category_id", "invitation", F.coalesce("affinities", F.expr("array()").cast(NO_TAGS)).alias("affinities")))).alias("own"))
        found = chosen.join(listed, "institution_type").join(rows.select("persona_uuid", "tags"), "persona_uuid")
        weights = F.transform("own", lambda c: 1.0 + F.size(F.filter(c["affinities"], lambda t: F.array_contains("tags", t))).cast("double"))
        dynamic = found.withColumn("c", _drawn(key, "category", F.col("own"), weights, seed)).select("persona_uuid", "institution_id", "institution_type", "c.category_id", "c.invitation")
        rows = rows.join(dynamic.select("persona_uuid", F.lit(True).alias("_dynamic")), "persona_uuid", "left")
        rows = rows.withColumn("tier", F.when(F.col("_dynamic"), DYNAMIC).otherwise(VERIFIABLE)).drop("_dynamic")

    named = templates.where(F.col("tier") == VERIFIABLE).withColumn("_task", F.concat_ws("\x1f", "institution_id", "template_id"))
    static = pick(rows.where(F.col("tier") == VERIFIABLE), named, key="persona_uuid", task="_task", seed=seed, salt="select").select("persona_uuid", "_task")
    static = static.join(named.drop("tier", "tags"), "_task", "left")
    salt = F.concat_ws("|", key.cast("string"), "institution_id", "template_id")
    static = static.withColumn("params", sampled_params(F.col("param_space"), salt, seed))
    quoted = F.transform_values("params", lambda _, v: F.regexp_replace(v, r'(["\\])', r"\\$1"))
    opening = F.get("openings", F.floor(hash_fraction(salt, F.lit("opening"), seed=seed) * F.size("openings")).cast("int"))
    static = static.select(
        "persona_uuid", F.lit(VERIFIABLE).alias("tier"), "institution_id", "institution_type", "template_id", fill_slots(opening, F.col("params")).alias("opening"), "params",
        fill_slots(F.col("account_state"), quoted).alias("account_state"), "gold_documents", "gold_tools", fill_slots(F.col("state_deltas"), quoted).alias("state_deltas"),
        F.lit(None).cast("string").alias("category_id"), F.lit(None).cast("string").alias("invitation"),
    )
    if dynamic is None:
        return static
    return static.unionByName(dynamic.withColumn("tier", F.lit(DYNAMIC)), allowMissingColumns=True)
