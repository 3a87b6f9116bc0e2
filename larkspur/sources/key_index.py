"""An index of a run's keys, so that new rows are told from stored ones without reading the run.

Keys lie in segments, one for each write; a segment has a Parquet file for each
bucket of keys (by hash) and a Bloom filter of that file. A batch tests its keys
against the filters of its buckets and reads only the bucket files that may hold
one of them. Eight segments of about one size are merged into one, so a run of n
keys has some eight segments for each power of eight in n, however many batches
wrote it.

The newest ``manifest-<n>.json`` names the segments and what the run's folder held
(files, bytes) when they were written. Where that isn't what the folder holds (a
writer died between its rows and its keys, or something else wrote), the index is
made anew from the run's keys. Functions that replace stored rows delete it first.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

BUCKETS = 64
#: So many segments of one size class (powers of it) are merged.
FAN = 8
#: Filter bits and probes for each key: one key in about 2,000 is looked for in vain.
BITS, PROBES = 16, 8


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def probes(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The ``PROBES`` bits of each key, by double hashing."""
    h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h1[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * h2[:, None]) % np.uint64(bits)


def bloom(h1: np.ndarray, h2: np.ndarray) -> bytes:
    bits = -(-max(len(h1), 1) * BITS // 8) * 8
    held = np.zeros(bits, np.uint8)
    held[probes(h1, h2, bits).ravel()] = 1
    return np.packbits(held).tobytes()


def may_hold(filter_bytes: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    held = np.frombuffer(filter_bytes, np.uint8)
    at = probes(h1, h2, 8 * len(held))
    return ((held[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1)


class KeyIndex:
    """The keys of one run. Callers hold the run's lock."""

    def __init__(self, spark: SparkSession, root: str, run: str, *, buckets: int = BUCKETS):
        self.spark, self.data, self.home = spark, f"{root}/run={run}", f"{root}/_keys/run={run}"
        fs, p = _fs(spark, self.home)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        self.number = max((int(n[9:-5]) for n in names if n.startswith("manifest-")), default=0)
        manifest = self._read(self.number) if self.number else {"buckets": buckets, "segments": [], "held": None}
        self.buckets, self.segments, self.held = manifest["buckets"], manifest["segments"], manifest["held"]
        #: Bucket files and filter files that the last lookup read.
        self.read_files, self.read_filters = 0, 0

    def _read(self, number: int) -> dict:
        fs, p = _fs(self.spark, f"{self.home}/manifest-{number}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folder_now(self) -> list[int]:
        """Files and bytes of the run."""
        fs, p = _fs(self.spark, self.data)
        if not fs.exists(p):
            return [0, 0]
        s = fs.getContentSummary(p)
        return [s.getFileCount(), s.getLength()]

    def current(self) -> bool:
        return (self.held or [0, 0]) == self.folder_now()

    def _hashed(self, keys: DataFrame) -> DataFrame:
        key = F.col(keys.columns[0]).cast("string")
        rows = keys.select(key.alias("key")).where("key is not null").distinct()
        h1 = F.xxhash64("key")
        return rows.select(F.pmod(h1, F.lit(self.buckets)).cast("int").alias("bucket"), "key", h1.alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))

    def _write(self, hashed: DataFrame) -> dict:
        """A segment of these rows (bucket, key, h1, h2)."""
        ship(self.spark)
        name = uuid.uuid4().hex
        keys, filters = f"{self.home}/keys/segment={name}", f"{self.home}/filters/segment={name}"
        hashed.repartition("bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(keys)

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "n": [len(frame)], "bits": [bloom(frame["h1"].to_numpy(), frame["h2"].to_numpy())]})

        stored = self.spark.read.schema("key string, h1 long, h2 long, bucket int").parquet(keys)
        stored.groupBy("bucket").applyInPandas(build, "bucket int, n long, bits binary").coalesce(1).write.parquet(filters)
        n = self.spark.read.schema("bucket int, n long, bits binary").parquet(filters).agg(F.sum("n")).first()[0]
        return {"name": name, "n": int(n or 0)}

    def _save(self, segments: list[dict]) -> None:
        """The next manifest; segments that neither it nor the one before names are deleted, as are older manifests."""
        fs, _ = _fs(self.spark, self.home)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        before = {s["name"] for s in self.segments}
        self.number, self.segments, self.held = self.number + 1, [s for s in segments if s["n"]], self.folder_now()
        text = json.dumps({"buckets": self.buckets, "segments": self.segments, "held": self.held})
        hidden = path(f"{self.home}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(hidden, path(f"{self.home}/manifest-{self.number}.json"))
        live = before | {s["name"] for s in self.segments}
        for part in ("keys", "filters"):
            folder = path(f"{self.home}/{part}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if s.getPath().getName().removeprefix("segment=") not in live:
                    fs.delete(s.getPath(), True)
        for s in fs.listStatus(path(self.home)):
            n = s.getPath().getName()
            if n.startswith("manifest-") and int(n[9:-5]) < self.number - 1:
                fs.delete(s.getPath(), False)

    def rebuild(self, keys: DataFrame) -> None:
        """From all keys of the run."""
        self._save([self._write(self._hashed(keys))])

    def touch(self) -> None:
        """The run's files were rewritten with the same keys."""
        self._save(self.segments)

    def add(self, keys: DataFrame) -> None:
        """Keys that were written to the run since; full size classes are merged."""
        segments = [*self.segments, self._write(self._hashed(keys))]
        while True:
            classes: dict[int, list[dict]] = {}
            for s in segments:
                size = 0
                while FAN ** (size + 1) <= s["n"]:
                    size += 1
                classes.setdefault(size, []).append(s)
            full = next((own for _, own in sorted(classes.items()) if len(own) >= FAN), None)
            if full is None:
                break
            rows = self.spark.read.schema("key string, h1 long, h2 long, bucket int").option("basePath", f"{self.home}/keys").parquet(*[f"{self.home}/keys/segment={s['name']}" for s in full])
            merged = self._write(rows.select("bucket", "key", "h1", "h2").distinct())
            segments = [s for s in segments if s not in full] + [merged]
        self._save(segments)

    def stored(self, keys: DataFrame) -> DataFrame:
        """(key): which of ``keys`` (one column) the run holds, as text."""
        self.read_files = self.read_filters = 0
        none = self.spark.createDataFrame([], "key string")
        if not self.segments:
            return none
        ship(self.spark)
        asked = self._hashed(keys)
        base = f"{self.home}/filters"
        filters = self.spark.read.schema("bucket int, n long, bits binary, segment string").option("basePath", base).parquet(*[f"{base}/segment={s['name']}" for s in self.segments])
        self.read_filters = len(self.segments)

        def test(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"segment": pd.Series([], dtype=str), "bucket": pd.Series([], dtype="int32"), "key": pd.Series([], dtype=str)})]
            if len(own):
                h1, h2 = own["h1"].to_numpy(), own["h2"].to_numpy()
                for segment, bits in zip(held["segment"], held["bits"], strict=True):
                    hit = own["key"][may_hold(bits, h1, h2)]
                    out.append(pd.DataFrame({"segment": segment, "bucket": own["bucket"].iloc[0], "key": hit}))
            return pd.concat(out)

        hits = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "segment string, bucket int, key string").persist()
        try:
            places = hits.select("segment", "bucket").distinct().collect()  # at most segments times buckets
            self.read_files = len(places)
            if not places:
                return none
            files = [f"{self.home}/keys/segment={p.segment}/bucket={p.bucket}" for p in places]
            held = self.spark.read.schema("key string").option("basePath", f"{self.home}/keys").parquet(*files).select("key")
            return asked.select("key").join(held, "key", "left_semi")
        finally:
            hits.unpersist()
