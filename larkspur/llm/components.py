"""Connected components of a link table, distributed, without collecting links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, prepare


def _local_forest(batches):
    """Union-find over one partition's links, a bounded number of them at a time; only a spanning forest goes on."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def forest():
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 300_000:
            yield forest()
            parent.clear()
    if parent:
        yield forest()


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) -> one row (node, root) per node; root is the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes; each round
    is checkpointed. Null ends and loops are ignored; no links: no rows.
    """
    prepare(links.sparkSession)
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = cut(links.mapInArrow(_local_forest, "a long, b long").distinct())
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(both.where("false")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("x"), F.col("m").alias("y")),
                    F.struct(F.col("b").alias("x"), F.col("m").alias("y")),
                )
            ).alias("l")
        )
        after = cut(small.select("l.x", "l.y").where("x <> y").distinct().toDF("a", "b"))
        if after.count() == links.count() and after.join(links, ["a", "b"], "left_anti").isEmpty():
            links = after
            break
        links = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
