"""Deterministic samples, resumable work and duplicate checks.

Samples order rows by a hash of key and seed, so they don't depend on how the
rows are partitioned or in which order they were written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def sample(df: DataFrame, mode: str, n: int, *, key: str, seed: int = 0, locale: str = "locale", probe: str = "probe_family", matched: str = "query_id") -> DataFrame:
    """``full``; ``first_n``; ``per_locale`` or ``per_locale_probe`` (n of each); ``matched_pair`` (all rows of the first n matched ids)."""
    if mode == "full":
        return df
    if mode == "first_n":
        return df.orderBy(key).limit(n)
    if mode == "matched_pair":
        ids = df.select(matched).where(F.col(matched).isNotNull()).distinct().orderBy(matched).limit(n)
        return df.join(ids, matched, "left_semi")
    if mode not in ("per_locale", "per_locale_probe"):
        raise ValueError(f"unknown sample mode {mode}")
    groups = [locale] if mode == "per_locale" else [locale, probe]
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(hash_order(F.col(key), seed), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def missing_rows(planned: DataFrame, saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned rows whose keys aren't saved yet, one per key."""
    fresh = planned.join(saved.select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys)), list(keys), "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*fresh.columns))).where("_r = 1").drop("_r")


def existing_ids(df: DataFrame, key: str = "trajectory_id") -> DataFrame:
    return df.select(key).where(F.trim(F.col(key).cast("string")) != "").distinct()


def repeated_ids(df: DataFrame, key: str = "trajectory_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def clear_foreign_columns(df: DataFrame, owner: dict[str, str], *, probe: str = "probe_family") -> DataFrame:
    """Columns that belong to one probe are null on the rows of all others."""
    return df.withColumns({c: F.when(F.col(probe) == p, F.col(c)) for c, p in owner.items() if c in df.columns})


def locale_filter(df: DataFrame, wanted: str, *, locale: str = "locale", language: str = "conversation_language") -> DataFrame:
    """By locale code or language label, whatever the case; ``english`` also takes every ``en_`` locale."""
    w = wanted.strip().lower()
    hit = (F.lower(F.trim(locale)) == w) | (F.lower(F.trim(language)) == w)
    return df.where(hit | F.lower(F.trim(locale)).startswith("en_") if w == "english" else hit)


def row_filter(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """All columns equal their values as text; an absent column keeps no row."""
    for c, v in values.items():
        df = df.where(F.col(c).cast("string") == v if c in df.columns else F.lit(False))
    return df
