"""Copy-on-write replacement of a column's values in a stored run: only files that hold changed rows are rewritten.

The new files are written to a hidden folder of the run, a journal names them and
the files that they replace, and then they are put in place and the old ones go. A
writer that dies before the journal is there has changed nothing; one that dies
later leaves the journal, and the next rewrite (or ``finish``) ends its work. While files are
exchanged, a reader that lists the run may see a row in its old and new file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .key_index import KeyIndex
from .runs import PARTITIONS, _children, _fs, _leaf_folders, read_dataset, read_files, read_json, run_lock, write_json

JOURNAL = ".rewrite-"


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _apply(spark: SparkSession, run_folder: str, name: str) -> None:
    """End the exchange that a journal describes; whatever of it is already done is left."""
    journal = f"{run_folder}/{name}.json"
    plan = read_json(spark, journal)
    fs, base = _fs(spark, run_folder)
    for new in plan["new"]:
        staged, place = _path(spark, f"{run_folder}/{name}/{new}"), _path(spark, f"{run_folder}/{new}")
        if fs.exists(staged):
            fs.mkdirs(place.getParent())
            fs.rename(staged, place)
    for old in plan["old"]:
        fs.delete(_path(spark, old), False)
    fs.delete(_path(spark, f"{run_folder}/{name}"), True)
    fs.delete(_path(spark, journal), False)


def finish(spark: SparkSession, root: str, run: str) -> int:
    """End rewrites whose writer died after its journal was written, and drop what others left behind; how many were ended.

    Call with the run's lock held.
    """
    folder = f"{root}/run={run}"
    names = [n for n in _children(spark, folder) if n.startswith(JOURNAL)]
    open_ = [n.removesuffix(".json") for n in names if n.endswith(".json")]
    for name in open_:
        _apply(spark, folder, name)
    fs, _ = _fs(spark, folder)
    for name in names:
        if not name.endswith(".json") and name not in open_:
            fs.delete(_path(spark, f"{folder}/{name}"), True)
    return len(open_)


def replace_values(fresh: DataFrame, root: str, run: str, *, key: str = "trajectory_id", column: str = "assistant_eval", needed: Column | None = None) -> dict[str, int]:
    """Put ``fresh`` (key, column) into the stored rows with these keys; {files, rewritten, rows, changed}.

    A row changes if ``needed`` (a condition on the stored row, ``column`` being the stored value) holds and the value
    differs; files without such rows are neither read as a whole nor written. Keys that aren't stored are ignored; of repeated
    fresh keys the greatest value counts; null keys match nothing. The run's only writer at a time; its key index stays.
    """
    spark, folder = fresh.sparkSession, f"{root}/run={run}"
    with run_lock(spark, root, run):
        finish(spark, root, run)
        index = KeyIndex(spark, root, run)
        indexed = bool(index.segments) and index.current()
        paths = _leaf_folders(spark, folder)
        new = fresh.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(column).alias("_new")).persist()
        try:
            stored = read_dataset(spark, root, run=run).withColumn("_file", F.input_file_name())
            # the file's name is read before the join, where it is still known
            stored = stored.select("_file", *[c for c in stored.columns if c != "_file"])
            differs = ~F.col(column).eqNullSafe(F.col("_new")) & (F.lit(True) if needed is None else F.coalesce(needed, F.lit(False)))
            hits = stored.join(new, F.col(key) == F.col("_key")).where(differs)
            hits = hits.select(F.col("_key").alias("_hit"), "_new", "_file").persist()
            try:
                files = [r[0] for r in hits.select("_file").distinct().collect()]  # at most the run's files
                changed = hits.count()
                if not files:
                    return {"files": len(paths), "rewritten": 0, "rows": 0, "changed": 0}
                uri = spark._jvm.java.net.URI
                old = sorted(spark._jvm.org.apache.hadoop.fs.Path(uri(f)).toString() for f in files)
                rows = read_files(spark, root, old).withColumn("_file", F.input_file_name())
                values = hits.select("_hit", "_new", F.col("_file").alias("_in")).distinct()
                same = (F.col(key) == F.col("_hit")) & (F.col("_file") == F.col("_in"))
                rows = rows.join(values, same, "left").withColumn(column, F.when(F.col("_hit").isNotNull(), F.col("_new")).otherwise(F.col(column)))
                name = f"{JOURNAL}{uuid.uuid4().hex}"
                # a task writes whole old files, so a file becomes one again
                staged = rows.repartition(min(len(old), 4 * spark.sparkContext.defaultParallelism), "_file").drop("_hit", "_new", "_in", "_file", "run")
                staged.write.partitionBy(*PARTITIONS[1:]).parquet(f"{folder}/{name}")
                base = _fs(spark, f"{folder}/{name}")
                prefix = base[0].makeQualified(base[1]).toString()
                # hidden folders aren't listed, so the staged files are listed from inside
                made = [p[len(prefix) + 1 :] for p in _leaf_folders(spark, f"{folder}/{name}")]
                n = spark.read.parquet(*[f"{folder}/{name}/{m}" for m in made]).count()
                write_json(spark, f"{folder}/{name}.json", {"new": made, "old": old})
                _apply(spark, folder, name)
            finally:
                hits.unpersist()
        finally:
            new.unpersist()
        if indexed:
            index.touch()
    return {"files": len(paths), "rewritten": len(files), "rows": n, "changed": changed}
