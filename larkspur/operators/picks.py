"""Seeded picks of a task for each person by tags, with levels to fall back to.

A task asks for tags; it fits a person who has all of them. Tasks that ask for the
same tags, at one level and of one kind, are one group with a size, so a person
meets groups, never tasks: an inverted list from tags to groups counts how many of
a group's tags a person has, once for each distinct set of tags. A person's draw
then falls into a group by weight, and into one of its numbered tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import hash_fraction

LEAST_WEIGHT = 1e-6


def asked_tags(tags: Column) -> Column:
    """The tags that a task asks for, sorted: wildcards (``age:any``) ask for nothing."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(tags, F.expr("array()").cast("array<string>")), lambda t: t.isNotNull() & ~t.rlike(r"^[^:]*:any$"))))


def _level(people: DataFrame, tasks: DataFrame, columns: Sequence[str], *, by_tags: bool) -> DataFrame:
    """``people`` that some group fits at this level, with ``_groups``: its groups (asked, kind, n), in order."""
    scope = [F.col(c).alias(f"_l{i}") for i, c in enumerate(columns)] or [F.lit(0).alias("_l0")]
    names = [f"_l{i}" for i in range(max(1, len(columns)))]
    asked = F.col("_asked") if by_tags else F.expr("array()").cast("array<string>").alias("_asked")
    groups = tasks.select(*scope, asked.alias("_asked"), "_kind").groupBy(*names, "_asked", "_kind").agg(F.count("*").alias("n"))
    groups = groups.dropna(subset=names)
    rows = people.select("*", *scope).withColumn("_has", F.array_sort(F.array_distinct("_tags")))
    sets = rows.select(*names, "_has").distinct()
    free = sets.join(groups.where(F.size("_asked") == 0), names)
    bound = groups.where(F.size("_asked") > 0).withColumn("_tag", F.explode("_asked"))
    met = sets.withColumn("_tag", F.explode("_has")).join(bound, [*names, "_tag"])
    met = met.groupBy(*names, "_has", "_asked", "_kind", "n").agg(F.count("*").alias("_m")).where(F.col("_m") == F.size("_asked"))
    fitting = free.select(*names, "_has", "_asked", "_kind", "n").unionByName(met.drop("_m"))
    listed = fitting.groupBy(*names, "_has").agg(F.array_sort(F.collect_list(F.struct(F.col("_asked").alias("asked"), F.col("_kind").alias("kind"), "n"))).alias("_groups"))
    # one row for each person: sets are distinct
    return rows.join(listed, [*names, "_has"], "left").drop("_has")


def pick(
    people: DataFrame, tasks: DataFrame, *, key: str, task: str = "task_id", levels: Sequence[Sequence[str]] = ((),), tags: str = "tags", asks: str = "tags", kind: str | None = None, weights: str | None = None, seed: int = 0, salt: str = "pick"
) -> DataFrame:
    """(key, task, level): one task for each person, from the first level that has one.

    ``levels`` name the columns that person and task must share, nearest level first; the last one is tried a second time
    without tags, as level ``len(levels)``. People without any task at that one have a null task. Within a level every
    fitting task is as likely, times the weight that the person's map ``weights`` gives the task's ``kind`` (1 where it has
    none, never under 0.000001). The draw is a hash of key, salt and seed. Keys are unique; null keys and rows with
    nulls in a level's columns find nothing there.
    """
    base = people.select(key, *dict.fromkeys(c for level in levels for c in level), F.coalesce(F.col(tags), F.expr("array()").cast("array<string>")).alias("_tags"), *([F.col(weights).alias("_w")] if weights else []))
    offered = tasks.select(F.col(task).alias("_task"), *dict.fromkeys(c for level in levels for c in level), asked_tags(F.col(asks)).alias("_asked"), (F.col(kind) if kind else F.lit("")).alias("_kind")).where("_task is not null")
    rest, out = base.where(F.col(key).isNotNull()), None
    for place, (columns, by_tags) in enumerate([*((c, True) for c in levels), (levels[-1], False)]):
        names = [f"_l{i}" for i in range(max(1, len(columns)))]
        matched = _level(rest, offered, columns, by_tags=by_tags)
        found = matched.where("_groups is not null")
        weight = lambda g: g["n"] * (F.greatest(F.coalesce(F.element_at("_w", g["kind"]), F.lit(1.0)).cast("double"), F.lit(LEAST_WEIGHT)) if weights else F.lit(1.0))
        sized = found.withColumn("_sizes", F.transform("_groups", weight))
        total = F.aggregate("_sizes", F.lit(0.0), lambda a, x: a + x)
        at = hash_fraction(F.col(key).cast("string"), F.lit(salt), seed=seed) * total
        # (what is left of the draw, the group it fell into): a group takes the draw if it is less than its size
        step = lambda s, i: F.when(s["i"].isNotNull(), s).when((s["u"] < F.get("_sizes", i)) | (i == F.size("_sizes") - 1), F.struct(s["u"].alias("u"), i.alias("i"))).otherwise(F.struct((s["u"] - F.get("_sizes", i)).alias("u"), F.lit(None).cast("int").alias("i")))
        fell = F.aggregate(F.sequence(F.lit(0), F.size("_sizes") - 1), F.struct(at.alias("u"), F.lit(None).cast("int").alias("i")), step)
        drawn = sized.withColumn("_f", fell).withColumn("_g", F.get("_groups", F.col("_f.i")))
        within = F.least(F.floor(F.col("_f.u") / (F.get("_sizes", F.col("_f.i")) / F.col("_g.n"))), F.col("_g.n") - 1)
        drawn = drawn.select(key, *names, F.col("_g.asked").alias("_asked"), F.col("_g.kind").alias("_kind"), within.cast("int").alias("_i"))
        scope = [F.col(c).alias(n) for c, n in zip(columns, names, strict=False)] or [F.lit(0).alias("_l0")]
        asked = F.col("_asked") if by_tags else F.expr("array()").cast("array<string>")
        numbered = offered.select("_task", *scope, asked.alias("_asked"), "_kind")
        numbered = numbered.withColumn("_i", F.row_number().over(Window.partitionBy(*names, "_asked", "_kind").orderBy("_task")) - 1)
        taken = drawn.join(numbered, [*names, "_asked", "_kind", "_i"]).select(key, F.col("_task").alias(task), F.lit(place).alias("level"))
        out = taken if out is None else out.unionByName(taken)
        rest = matched.where("_groups is null").drop("_groups", *names)
    return out.unionByName(rest.select(key, F.lit(None).cast(tasks.schema[task].dataType).alias(task), F.lit(None).cast("int").alias("level")))


def document_plan(products: DataFrame, *, key: str, genres: str = "genres", target: str = "target_docs") -> DataFrame:
    """(key, slot, genre, angle): document slots of a product, one genre after another, as many as ``target`` asks for.

    ``genres`` is an array of (genre, angles) in order. Each round gives every genre that still has angles its next one; a
    repeated angle of a genre counts once. The slot of a genre's n-th angle is told by the genres' sizes alone: all earlier
    rounds' slots, and those of the genres before it in this round. A plan ends where the angles do.
    """
    own = F.transform(F.coalesce(F.col(genres), F.array().cast(products.schema[genres].dataType)), lambda g: F.struct(g["genre"].alias("genre"), F.array_distinct(g["angles"]).alias("angles")))
    rows = products.select(key, F.col(target).alias("_target"), own.alias("_own")).withColumn("_sizes", F.transform("_own", lambda g: F.greatest(F.size(g["angles"]), F.lit(0))))
    earlier = lambda n: F.aggregate("_sizes", F.lit(0), lambda s, size: s + F.least(size, n))
    before = lambda p, n: F.size(F.filter(F.slice("_sizes", 1, p), lambda size: size > n))
    slots = F.transform("_own", lambda g, p: F.transform(F.coalesce(g["angles"], F.expr("array()").cast("array<string>")), lambda a, n: F.struct((earlier(n) + before(p, n)).alias("slot"), g["genre"].alias("genre"), a.alias("angle"))))
    kept = F.filter(F.flatten(slots), lambda s: s["slot"] < F.col("_target"))
    return rows.select(key, F.explode(kept).alias("s")).select(key, "s.slot", "s.genre", "s.angle")
