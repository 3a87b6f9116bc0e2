"""Episode inputs: drawing personas, probes and themes without a model, and reading stored ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import hash_fraction, joined_id, rendezvous_pick, weighted_pick

#: So many personas are numbered by one task.
RANGE = 100_000


def parse_mix(text: str) -> dict[str, float]:
    """``a=2,b=1`` as weights; a name alone weighs 1; none or negative ones are an error."""
    out: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, weight = part.partition("=")
        out[name.strip()] = float(weight) if weight else 1.0
    if not out or min(out.values()) < 0 or sum(out.values()) <= 0:
        raise ValueError(f"no usable weights in {text!r}")
    return out


def materialize(spark: SparkSession, n: int, personas: DataFrame, mix: Mapping[str, float], themes: Mapping[str, Sequence[str]], *, seed: int = 0, locale: str = "en_US") -> DataFrame:
    """``n`` inputs: a persona (persona_uuid and its other columns), a probe by weight and one of the probe's themes.

    Personas are numbered in one list by a hash of their id and drawn by hash, so
    inputs depend only on the seed, not on partitions. The list is made in ranges
    of the hash, some ``RANGE`` personas each.
    """
    count = personas.count()
    if not count:
        raise ValueError("there are no personas")
    buckets = max(1, -(-count // RANGE))
    hashed = personas.withColumn("_h", F.md5(F.concat_ws("|", "persona_uuid", F.lit(str(seed)))))
    first = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / float(1 << 48)
    hashed = hashed.withColumn("_bucket", F.floor(first * buckets).cast("int"))  # in the hashes' order
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", "persona_uuid"))
    numbered = hashed.withColumn("_own", own).join(F.broadcast(sizes.select("_bucket", before.alias("_before"))), "_bucket")
    numbered = numbered.withColumn("_at", F.col("_before") + F.col("_own") - 1).drop("_bucket", "_h", "_own", "_before")
    rows = spark.range(n).withColumn("_at", F.floor(hash_fraction(F.col("id"), seed=seed) * count))
    drawn = rows.join(numbered, "_at").drop("_at")
    drawn = drawn.withColumn("probe_family", weighted_pick(F.col("id"), dict(mix), seed=seed + 2))
    theme = F.lit(None).cast("string")
    for probe, names in themes.items():
        theme = F.when(F.col("probe_family") == probe, rendezvous_pick(F.col("id"), F.array(*[F.lit(t) for t in names]), f"{probe}:{seed}")).otherwise(theme)
    return drawn.withColumns({"theme": theme, "locale": F.lit(locale)}).withColumn("trajectory_id", joined_id(F.col("persona_uuid"), F.col("probe_family"), F.col("theme"), F.col("id"), F.lit(seed)))


def load_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Stored inputs from ``.jsonl`` or ``.parquet``; a struct column ``episode`` is unpacked."""
    if path.endswith((".jsonl", ".json")):
        df = spark.read.json(path)
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"{path}: inputs are .jsonl or .parquet")
    if dict(df.dtypes).get("episode", "").startswith("struct"):
        rest = [c for c in df.columns if c != "episode"]
        df = df.select(*rest, "episode.*")
    return df


def as_text_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [n for n, t in df.dtypes if t.startswith(("struct", "array", "map"))]
    return df.withColumns({n: F.to_json(n) for n in nested})


def attach_seed_rows(inputs: DataFrame, seeds: DataFrame, *, key: str) -> DataFrame:
    """The n-th input (by key) with the n-th seed row, beginning anew when seeds run out; seeds carry ``seed_no`` from 0."""
    count = seeds.count()
    if not count:
        raise ValueError("there are no seed rows")
    per = Window.partitionBy("_p").orderBy(key)
    spread = inputs.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id())
    spread = spread.withColumn("_i", F.row_number().over(per))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_c"))
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    numbered = spread.join(offsets, "_p").withColumn("seed_no", (F.col("_i") + F.col("_o") - 1) % count)
    return numbered.drop("_p", "_i", "_o").join(seeds, "seed_no")


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """Settings with ``over`` on top: maps merge, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def layer_by_id(base: Sequence[Mapping], over: Sequence[Mapping], *, select: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[dict]:
    """Entries merged by ``id`` in the base's order, new ones after; then only the selected, without the excluded."""
    merged = {e["id"]: dict(e) for e in base}
    for e in over:
        merged[e["id"]] = deep_merge(merged.get(e["id"], {}), e)
    return [e for i, e in merged.items() if (select is None or i in select) and i not in exclude]


def unpack(rows: DataFrame, column: str = "episode") -> DataFrame:
    """A stored episode's fields as columns; a field replaces a column of its name."""
    fields = rows.schema[column].dataType.names
    return rows.select(*[c for c in rows.columns if c != column and c not in fields], *[F.col(f"{column}.{f}") for f in fields])


def undeclared_columns(df: DataFrame, declared: Sequence[str], inputs: Sequence[str] = ()) -> list[str]:
    """Columns that a probe made without declaring them, sorted; a run wouldn't keep these."""
    return sorted(set(df.columns) - set(declared) - set(inputs))


def seed_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns of a seed file: the schema of a Parquet file, else every key of a JSON-lines file, sorted."""
    return sorted((spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)).columns)


def explode_institutions(banks: DataFrame, *, batch: int = 4) -> DataFrame:
    """(institution_id, cluster_kind, document_type, position, batch): nested institution banks as one row per document.

    ``banks`` is (institution_id, clusters array<struct<kind, documents array<string>>>); a cluster's documents are
    numbered and put into batches of ``batch``.
    """
    clusters = banks.select("institution_id", F.explode("clusters").alias("c"))
    docs = clusters.select("institution_id", F.col("c.kind").alias("cluster_kind"), F.posexplode("c.documents").alias("position", "document_type"))
    return docs.withColumn("batch", F.floor(F.col("position") / batch).cast("int"))


def regroup_institutions(docs: DataFrame, *, id_col: str = "document_id") -> DataFrame:
    """(institution_id, n_documents, documents): rows as nested banks in order of position; of equal ids the first stays."""
    first = docs.groupBy("institution_id", id_col).agg(F.min(F.struct("cluster_kind", "position", "document_type")).alias("d"))
    listed = F.array_sort(F.collect_list(F.struct("d.cluster_kind", "d.position", F.col(id_col), "d.document_type")))
    return first.groupBy("institution_id").agg(F.count("*").alias("n_documents"), listed.alias("documents"))
