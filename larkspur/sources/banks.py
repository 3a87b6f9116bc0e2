"""Small reference banks from YAML or JSON files as DataFrames, with a fallback locale."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .runs import _fs, exists, write_json


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def load_bank(spark: SparkSession, path: str) -> dict | list:
    """The content of a ``.json``, ``.yaml`` or ``.yml`` file (YAML needs PyYAML)."""
    text = _text(spark, path)
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        raise RuntimeError(f"{path}: reading YAML needs PyYAML") from None
    return yaml.safe_load(text)


def bank_frame(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """A section's entries as rows; lists and maps in text columns become JSON."""
    bank = load_bank(spark, path)
    entries = bank[section] if isinstance(bank, dict) else bank
    fields = [f.split() for f in schema.split(", ")]
    value = lambda e, n, t: json.dumps(e[n], ensure_ascii=False) if t == "string" and isinstance(e.get(n), (list, dict)) else e.get(n)
    return spark.createDataFrame([tuple(value(e, n, t) for n, t in fields) for e in entries], schema)


def load_seeds(spark: SparkSession, root: str, locale: str, probe: str, kind: str, default: str = "en_US") -> list:
    """Entries of ``root/locale/probe/kind.json`` (or YAML), else those of the default locale, else none."""
    for code in dict.fromkeys((locale, default)):
        for end in ("json", "yaml", "yml"):
            path = f"{root}/{code}/{probe}/{kind}.{end}"
            if exists(spark, path):
                return load_bank(spark, path) or []
    return []


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, embedding) beside a bank, or None where there are none."""
    return spark.read.parquet(path).select("id", "embedding") if exists(spark, path) else None


#: Tables of a bank and the keys that each must have.
TABLES = {"institutions": ("institution_id",), "documents": ("institution_id", "document_id"), "tools": ("institution_id", "name"), "templates": ("institution_id", "template_id"), "vectors": ("id", "embedding")}


def write_tables(root: str, region: dict, **tables: DataFrame) -> None:
    """Write a locale's bank: ``region.json`` and the tables given, each in a folder, by institution where it has one.

    A table that isn't given stays as it was, so a new corpus doesn't replace curated templates; one that is given is replaced
    as a whole. Missing keys are an error before anything is written.
    """
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"a bank has no table {name}; it has {', '.join(TABLES)}")
        if missing := [c for c in TABLES[name] if c not in df.columns]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("institution_id") if "institution_id" in df.columns and name != "institutions" else writer).parquet(f"{root}/{name}")
    if tables:
        write_json(next(iter(tables.values())).sparkSession, f"{root}/region.json", {"schema_version": 1, **region})


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that a bank has, with institutions' ids as text."""
    found = {n: spark.read.parquet(f"{root}/{n}") for n in TABLES if exists(spark, f"{root}/{n}")}
    return {n: df.withColumn("institution_id", df["institution_id"].cast("string")) if "institution_id" in df.columns else df for n, df in found.items()}
