"""Run-partitioned Parquet datasets: ``run=/locale=/probe_family=`` with schema-drift repair."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ("run", "locale", "probe_family")
LEGACY = "legacy"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def list_runs(spark: SparkSession, root: str) -> list[str]:
    """Run ids, oldest first; ``legacy`` where only bare ``locale=`` folders exist."""
    names = _children(spark, root)
    runs = [n.removeprefix("run=") for n in names if n.startswith("run=")]
    if not runs and any(n.startswith("locale=") for n in names):
        return [LEGACY]
    return sorted(runs, key=lambda r: (not r.isdigit(), int(r) if r.isdigit() else 0, r))


def resolve_run(spark: SparkSession, root: str, run: str | None = "latest") -> str | None:
    """A run id from ``latest``, ``all`` (None), None (latest) or an id, which must exist."""
    runs = list_runs(spark, root)
    if run == "all":
        return None
    if run in (None, "latest"):
        if not runs:
            raise FileNotFoundError(f"no runs under {root}")
        return runs[-1]
    if str(run) not in runs:
        raise FileNotFoundError(f"no run {run} under {root}; there are: {', '.join(runs) or 'none'}")
    return str(run)


# Types by how much they can hold; where files differ the highest wins, else text.
_RANK = [T.NullType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.TimestampType, T.BinaryType, T.StringType, T.ArrayType]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that both convert to: the higher ranked one; structs merge by field; other mixes are text."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merge_schemas([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if type(a) in _RANK[:8] and type(b) in _RANK[:8]:
        return max(a, b, key=lambda t: _RANK.index(type(t)))
    return T.StringType()


def merge_schemas(schemas: Sequence[T.StructType]) -> T.StructType:
    merged: dict[str, T.DataType] = {}
    for s in schemas:
        for f in s.fields:
            merged[f.name] = wider(merged[f.name], f.dataType) if f.name in merged else f.dataType
    return T.StructType([T.StructField(k, v) for k, v in merged.items()])


def _convert(name: str, have: T.DataType, want: T.DataType):
    c = F.col(f"`{name}`")
    if have == want:
        return c
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c).alias(name)
    return c.cast(want).alias(name)


def _leaf_folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    files, found = fs.listFiles(p, True), set()
    while files.hasNext():
        f = files.next().getPath()
        relative = f.toString()[len(fs.makeQualified(p).toString()) :]
        if f.getName().endswith(".parquet") and not any(part.startswith((".", "_")) for part in relative.split("/") if part):
            found.add(f.toString())
    return sorted(found)


def _footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, schema) of each file: the schema as Spark wrote it into the footer, else the Arrow schema in hexadecimal.

    The footers are read by tasks, many files at a time.
    """
    from urllib.parse import quote

    import pyarrow as pa
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    def run(batches):
        for batch in batches:
            texts = []
            for path in batch.column(0).to_pylist():
                fs, place = pafs.FileSystem.from_uri(quote(path if "://" in path else "file://" + path.removeprefix("file:"), safe="/:@"))
                with fs.open_input_file(place) as f:
                    schema = pq.read_schema(f)
                own = (schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
                texts.append(own.decode() if own else schema.remove_metadata().serialize().to_pybytes().hex())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "schema"])

    tasks = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(pa.table({"path": list(paths)})).repartition(tasks).mapInArrow(run, "path string, schema string")


def _schema_of(text: str) -> T.StructType:
    if text.startswith("{"):
        return T.StructType.fromJson(json.loads(text))
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(text))))


def _same_types(schemas: Sequence[T.StructType]) -> bool:
    """Whether columns of one name have one type everywhere, so that one scan can read all files."""
    seen: dict[str, T.DataType] = {}
    return all(seen.setdefault(f.name, f.dataType) == f.dataType for s in schemas for f in s.fields)


def read_dataset(spark: SparkSession, root: str, *, run: str | None = "latest", columns: Sequence[str] | None = None) -> DataFrame:
    """A dataset's run (or ``all``), with every column that any file has.

    Only distinct schemas come back from the footers. Where files differ in their columns but not in types, one scan
    reads the folder under the merged schema; where types differ, files are read by their schema, converted to the merged
    one and united. Partition values are text.
    """
    run = resolve_run(spark, root, run)
    base = root if run in (None, LEGACY) else f"{root}/run={run}"
    paths = _leaf_folders(spark, base)
    if not paths:
        raise FileNotFoundError(f"no files under {base}")
    out = read_files(spark, root, paths, folder=base)
    return out.select(*columns) if columns else out


def read_files(spark: SparkSession, root: str, paths: Sequence[str], *, folder: str | None = None) -> DataFrame:
    """Files of the dataset at ``root`` as ``read_dataset`` reads them; ``folder`` holds these files and no others."""
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        footers = _footers(spark, paths)
        schemas = {r.schema: _schema_of(r.schema) for r in footers.select("schema").distinct().collect()}
        whole = merge_schemas([schemas[k] for k in sorted(schemas)])
        if _same_types(list(schemas.values())):
            return spark.read.option("basePath", root).schema(whole).parquet(*([folder] if folder else paths))
        groups = {r.schema: r.paths for r in footers.groupBy("schema").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()}
        parts = []
        for k in sorted(groups):
            part = spark.read.option("basePath", root).parquet(*groups[k])
            own = {f.name: f.dataType for f in schemas[k].fields}
            keys = [c for c in part.columns if c not in own]
            parts.append(part.select(*[_convert(f.name, own[f.name], f.dataType) for f in whole.fields if f.name in own], *keys))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", before)


def write_run(df: DataFrame, root: str, run: str, *, overwrite: bool = False, partitions: Sequence[str] = PARTITIONS[1:]) -> None:
    """Write a run; an existing one is replaced as a whole with ``overwrite``, else refused."""
    missing = [p for p in partitions if p not in df.columns]
    if missing:
        raise ValueError(f"partition columns are missing: {', '.join(missing)}")
    if overwrite:
        _forget_keys(df.sparkSession, root, run)
    df.drop("run").write.partitionBy(*partitions).mode("overwrite" if overwrite else "errorifexists").parquet(f"{root}/run={run}")


def _forget_keys(spark: SparkSession, root: str, run: str) -> None:
    """Before stored rows are replaced: the key index of a run goes; the next append makes it anew."""
    fs, p = _fs(spark, f"{root}/_keys/run={run}")
    fs.delete(p, True)


def write_locales(df: DataFrame, root: str, run: str, locales: Sequence[str]) -> None:
    """Replace only the named locales of a run; rows of others are an error, no rows at all a no-op."""
    if df.isEmpty():
        return
    foreign = [r[0] for r in df.where(~F.col("locale").isin(*locales) | F.col("locale").isNull()).select("locale").distinct().limit(5).collect()]
    if foreign:
        raise ValueError(f"rows of other locales: {foreign}")
    spark, path = df.sparkSession, f"{root}/run={run}"
    with run_lock(spark, root, run):
        _forget_keys(spark, root, run)
        # One commit replaces the families that the new rows have; only then do the locales' other families go.
        df.drop("run").write.partitionBy(*PARTITIONS[1:]).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        new = {(r.locale, r.probe_family) for r in df.select("locale", "probe_family").distinct().collect()}
        fs, base = _fs(spark, path)
        place = spark._jvm.org.apache.hadoop.fs.Path
        written = {f"locale={x}/probe_family={'__HIVE_DEFAULT_PARTITION__' if y is None else spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(y)}" for x, y in new}
        for locale in dict.fromkeys(locales):
            for family in _children(spark, f"{path}/locale={locale}"):
                if f"locale={locale}/{family}" not in written:
                    fs.delete(place(base, f"locale={locale}/{family}"), True)


def append_new(df: DataFrame, root: str, run: str, *, key: str = "trajectory_id") -> DataFrame:
    """Append the rows whose keys the run doesn't hold yet, as the run's only writer; returns them.

    Keys are compared as text. The run isn't read: see ``key_index``. Rows without a key are always new.
    """
    from .key_index import KeyIndex

    spark, path = df.sparkSession, f"{root}/run={run}"
    fresh = df.dropDuplicates([key])
    with run_lock(spark, root, run):
        index = KeyIndex(spark, root, run)
        if not index.current():
            index.rebuild(read_dataset(spark, root, run=run, columns=[key]) if exists(spark, path) else fresh.select(key).limit(0))
        stored = index.stored(fresh.select(key)).withColumnRenamed("key", "_stored_key")
        fresh = fresh.join(stored, F.col(key).cast("string") == F.col("_stored_key"), "left_anti")
        fresh.drop("run").write.partitionBy(*PARTITIONS[1:]).mode("append").parquet(path)
        index.add(fresh.select(key))
    return fresh


def load_runs(spark: SparkSession, root: str, runs: Sequence[str], *, key: str = "trajectory_id") -> DataFrame:
    """Several runs, each key from the first run in the list that has it."""
    from ..operators.selection import keep_first

    both = None
    for n, run in enumerate(runs):
        part = read_dataset(spark, root, run=run).withColumn("_run_order", F.lit(n))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    if both is None:
        raise ValueError("no runs")
    return keep_first(both, [key], ["_run_order"]).drop("_run_order")


def write_file(df: DataFrame, path: str) -> None:
    """``df`` as one Parquet file at ``path``, for tables that people open themselves; it is in place as a whole or not at all.

    One task writes it. An old file is replaced.
    """
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path
    hidden = place(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    try:
        df.coalesce(1).write.parquet(hidden.toString())
        part = next(s.getPath() for s in fs.listStatus(hidden) if s.getPath().getName().endswith(".parquet"))
        fs.delete(p, True)
        fs.rename(part, p)
    finally:
        fs.delete(hidden, True)


def partition_values(df: DataFrame, column: str) -> list[str]:
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file beside a dataset, put in place by a rename."""
    fs, p = _fs(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), "." + p.getName())
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode("utf-8")))
    out.close()
    fs.delete(p, False)
    fs.rename(hidden, p)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_curated(df: DataFrame, root: str, run: str, profile: str, manifest: dict) -> None:
    """``run=/profile=/locale=/probe_family=`` and its manifest."""
    path = f"{root}/run={run}/profile={profile.replace(':', '_')}"
    df.drop("run", "profile").write.partitionBy("locale", "probe_family").mode("overwrite").parquet(path)
    write_json(df.sparkSession, f"{path}/_selection_manifest.json", manifest)


def publish_new_run(df: DataFrame, root: str, run: str, partitions: Sequence[str] = PARTITIONS[1:]) -> str:
    """Write to a hidden folder and rename it to ``run=``; where the id is taken, the next free number is used."""
    spark = df.sparkSession
    fs, base = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    hidden = path(base, f".claim-{run}-{uuid.uuid4().hex}")
    df.drop("run").write.partitionBy(*partitions).parquet(hidden.toString())
    number = int(run)
    while fs.exists(path(base, f"run={number}")) or not fs.rename(hidden, path(base, f"run={number}")):
        number += 1
    return str(number)


@contextmanager
def run_lock(spark: SparkSession, root: str, run: str, stale_s: float = 3600):
    """One writer at a time for a run, by a file that only one can create.

    The file holds its owner's token and is touched while the owner lives; one that wasn't for ``stale_s`` is taken over,
    by a rename that only one can make. An owner deletes the file only if it is still its own.
    """
    fs, base = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    lock, token = path(base, f".lock-{run}"), uuid.uuid4().hex
    fs.mkdirs(base)

    def owner() -> str | None:
        try:
            stream = fs.open(lock)
        except Exception:
            return None
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    if fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > stale_s:
        old = path(base, f".lock-{run}-stale-{token}")
        if fs.rename(lock, old):
            fs.delete(old, False)
    try:
        out = fs.create(lock, False)
    except Exception as e:
        raise RuntimeError(f"run {run} is being written by another process") from e
    out.write(bytearray(token.encode()))
    out.close()
    ended = threading.Event()

    def renew() -> None:
        while not ended.wait(stale_s / 4):
            if owner() == token:
                fs.setTimes(lock, int(time.time() * 1000), -1)

    keeper = threading.Thread(target=renew, daemon=True)
    keeper.start()
    try:
        yield
    finally:
        ended.set()
        keeper.join()
        if owner() == token:
            fs.delete(lock, False)


def write_reports(spark: SparkSession, folder: str, reports: dict[str, DataFrame], limit: int = 100_000) -> None:
    """Small report frames as JSON files; one of more than ``limit`` rows is an error."""
    for name, df in reports.items():
        rows = df.limit(limit + 1).toJSON().collect()
        if len(rows) > limit:
            raise ValueError(f"{name} has more than {limit} rows; write it as Parquet")
        write_json(spark, f"{folder}/{name}.json", {"rows": [json.loads(r) for r in rows]})
