"""Helpers that several corpus operators use."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a
    temporary folder made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive lost executors and the lineage ends."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one Arrow batch of texts may hold; both the JVM and the Python worker keep a batch as a whole.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Before Python workers are used: send them the package, and lower the session's Arrow batches to ``BATCH_ROWS``
    rows where they are larger (results don't depend on it)."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exactly two columns, ``id`` and ``text`` (null text: empty), whatever else ``df`` holds."""
    prepare(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def forget_tables() -> None:
    """In a Python worker: drop the tokenizer tables that tasks of an earlier stage have left in it, before other large ones are made."""
    for name, table in (("bpe", "prefix_encoder"), ("token_counts", "piece_table")):
        module = sys.modules.get(f"{__package__}.{name}")
        if module is not None:
            getattr(module, table).cache_clear()
