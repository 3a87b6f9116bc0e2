"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, each with its own table. The search grows the
radius one segment at a time: once ``j`` segments have been searched to radius r
and the others to r - 1, a code not yet met differs in at least
``j * (r + 1) + (segments - j) * r`` bits. The search ends when the k-th verified
distance is below that.

The codes are cut into blocks. Each code goes to one block, whose tables are
built once; the queries are streamed through every block, and the blocks'
answers are merged.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .shared import keep_table, prepare

#: Most codes of an index block, and fewest where the codes are spread over the cores.
INDEX_ROWS, SPREAD_ROWS = 1_000_000, 4096
WORD = 64


class MultiIndex:
    """Segment tables over one block of codes; ``codes`` has a row of 64-bit words for each."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, np.ascontiguousarray(codes.reshape(len(ids), -1)).view(np.uint64)
        width = int(np.clip(np.log2(max(len(ids), 2)), 8, 16))
        places = [(word, lo, min(width, WORD - lo)) for word in range(self.codes.shape[1]) for lo in range(0, WORD, width)]
        self.segments = [(word, lo, w, *self._table(word, lo, w)) for word, lo, w in places]
        self.balls: dict[tuple[int, int], np.ndarray] = {}
        self.met_by, self.asked = np.zeros(len(ids), np.int64), 0  # the last query that met each code

    @staticmethod
    def _value(words, lo, w):
        return ((words >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.int64)

    def _table(self, word: int, lo: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        value = self._value(self.codes[:, word], lo, w)
        starts = np.zeros((1 << w) + 1, np.int64)
        np.cumsum(np.bincount(value, minlength=1 << w), out=starts[1:])
        return np.argsort(value, kind="stable"), starts

    def _ball(self, w: int, radius: int) -> np.ndarray:
        """All changes of exactly ``radius`` of ``w`` bits."""
        if (w, radius) not in self.balls:
            self.balls[w, radius] = np.array([sum(1 << b for b in c) for c in combinations(range(w), radius)], np.int64)
        return self.balls[w, radius]

    def _best(self, rows, distances, k):
        best = np.lexsort((self.ids[rows], distances))[:k]
        return rows[best], distances[best]

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and distances of the ``k`` nearest (distance, then id)."""
        code = np.atleast_1d(code).view(np.uint64)
        self.asked += 1
        rows, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(max(w for _, _, w, _, _ in self.segments) + 1):
            for j, (word, lo, w, order, starts) in enumerate(self.segments):
                if radius <= w:
                    at = int(self._value(code[word : word + 1], lo, w)[0]) ^ self._ball(w, radius)
                    begin, size = starts[at], starts[at + 1] - starts[at]
                    begin, size = begin[size > 0], size[size > 0]
                    if len(size):
                        met = order[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                        met = met[self.met_by[met] != self.asked]
                        if len(met):
                            self.met_by[met] = self.asked
                            rows = np.concatenate([rows, met])
                            distances = np.concatenate([distances, np.bitwise_count(self.codes[met] ^ code).sum(axis=1, dtype=np.int64)])
                            if len(rows) > 4 * k:
                                rows, distances = self._best(rows, distances, k)
                covered = (j + 1) * (radius + 1) + (len(self.segments) - j - 1) * radius
                if len(rows) >= k and np.partition(distances, k - 1)[k - 1] < covered:
                    return self._best(rows, distances, k)
        return self._best(rows, distances, k)


def sign_codes(vectors: DataFrame, *, bits: int = WORD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i is set where element i is above zero (NaN counts as above, a null or missing element as not).

    ``code`` is a long for up to 64 bits, else an array of longs. Rows with a null
    id or vector have no code; a vector of more than ``bits`` elements is an error.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("id is not null and v is not null")
    bit = lambda k: F.when(F.get("v", k) > 0, F.expr("1L")).otherwise(F.expr("0L"))

    def word(n):
        places = F.sequence(F.lit(0), F.lit(WORD - 1))
        return F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.call_function("shiftleft", bit(k + WORD * n), k)))

    words = [word(n) for n in range(-(-bits // WORD))]
    code = words[0] if len(words) == 1 else F.array(*words)
    too_long = F.raise_error(F.lit(f"a vector of more than {bits} elements")).cast("long" if len(words) == 1 else "array<bigint>")
    return rows.select("id", F.when(F.size("v") > bits, too_long).otherwise(code).alias("code"))


def top_k(queries: DataFrame, codes: DataFrame, *, k: int = 10, index_rows: int = INDEX_ROWS, spread_rows: int = SPREAD_ROWS) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) of the ``k`` nearest codes of each query, exactly.

    Both tables are (id, code), with codes as ``sign_codes`` gives them. Codes lie
    in blocks of at most about ``index_rows``, and in as many as there are cores
    while these hold ``spread_rows``. Equal distances rank by id; a query that is
    repeated is asked once. Where fewer than ``k`` codes exist all are returned;
    empty tables give an empty result.
    """
    spark = codes.sparkSession
    prepare(spark)
    as_words = lambda df: df.select("id", (F.col("code") if isinstance(df.schema["code"].dataType, ArrayType) else F.array("code")).alias("code"))
    n = codes.count()
    blocks = max(1, -(-n // index_rows), min(spark.sparkContext.defaultParallelism, n // spread_rows))
    held = as_words(codes).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    asked = as_words(queries).distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    rows = held.union(asked).repartitionByRange(blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches):
        now, index, parts = None, None, []
        for batch in batches:
            ids, blocks_, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "block", "asks"))
            lists = batch.column("code")
            words = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            edges = np.flatnonzero(np.r_[True, (blocks_[1:] != blocks_[:-1]) | (asks[1:] != asks[:-1])]) if len(ids) else []
            for a, b in zip(edges, [*edges[1:], len(ids)], strict=True):
                if blocks_[a] != now:
                    now, index, parts = blocks_[a], None, []
                if not asks[a]:
                    parts.append((ids[a:b], words[a:b]))
                    continue
                if index is None and parts:
                    index = MultiIndex(*(np.concatenate(p) for p in zip(*parts, strict=True)))
                    parts = []
                out = [index.search(words[q], k) for q in range(a, b)] if index is not None else []
                if out:
                    sizes = [len(r) for r, _ in out]
                    columns = [np.repeat(ids[a:b], sizes), index.ids[np.concatenate([r for r, _ in out])], np.concatenate([d for _, d in out])]
                    code = pa.ListArray.from_arrays(pa.array(np.arange(0, sum(sizes) * words.shape[1] + 1, words.shape[1]), pa.int32()), pa.array(np.repeat(words[a:b], sizes, axis=0).ravel()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), code], names=["query_id", "neighbor_id", "distance", "code"])

    found = rows.mapInArrow(run, "query_id long, neighbor_id long, distance long, code array<long>")
    rank = F.row_number().over(Window.partitionBy("query_id", "code").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("code")


def search_vectors(vectors: DataFrame, *, every: int = 50, k: int = 10, bits: int = WORD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Top-k by Hamming distance of sign codes for each row whose id is divisible by ``every``, against all rows (itself too).

    A repeated row is asked once, but found as often as it is there.
    """
    codes = keep_table(sign_codes(vectors, bits=bits, id_col=id_col, vector_col=vector_col), "codes")
    return top_k(codes.where(F.col("id") % every == 0), codes, k=k)
