"""Embedding whitening: the leading principal components of a table of vectors, each with unit variance.

Entries become integers, so counts and sums, and with them the centred rows, are
exact. MLlib's ``RowMatrix.computeGramianMatrix`` over the centred rows, divided
by their number, is the covariance; its eigenvectors are found on the driver (the
matrix has the vectors' dimension, not their number) and broadcast to
``mapInPandas``, which projects the rows. A second Gramian, of the whitened rows,
tells how far their covariance is from the identity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep_table, prepare

COMPONENTS = 32
STEP, SHIFT = 64, 1_000_000
#: Entries beyond this have no integer of their own; such rows are an error, not a wrong result.
LARGEST = 2.0**52 / STEP
#: Components with less variance than this share of the first's have no direction of their own.
FLAT = 1e-12


def integer_rows(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): each vector without null or non-finite entries as floor(64 * entry) + 1000000."""
    entry = lambda c: F.floor(F.lit(float(STEP)) * c.cast("double")).cast("long") + SHIFT
    # not (|c| < infinity) is true of infinities and NaN, which Spark puts above them
    good = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(F.col("v").isNotNull() & good)
    large = F.exists("v", lambda c: F.abs(c.cast("double")) > LARGEST)
    return rows.select("id", F.when(large, F.raise_error("a vector has an entry too large for exact sums").cast("array<bigint>")).otherwise(F.transform("v", entry)).alias("x"))


def _dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sums of each dimension: one partial row a dimension and task."""

    def partial(frames):
        n, sums = 0, None
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                own = np.array([sum(map(int, c)) for c in x.T], object) if np.abs(x).max() > 2**40 else x.sum(0).astype(object)
                n, sums = n + len(x), own if sums is None else sums + own
        if n:
            yield pd.DataFrame({"d": range(len(sums)), "n": n, "s": [str(v) for v in sums]})

    sums = rows.select("x").mapInPandas(partial, "d int, n long, s string").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sums.orderBy("d").collect()  # as many rows as dimensions
    return (found[0].n, [int(r.s) for r in found]) if found else (0, [])


def _covariance(rows: DataFrame, n: int) -> np.ndarray:
    """The Gramian of centred rows (one column of double arrays), by their number."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(rows.columns[0])).alias("v")), "v")
    gram = RowMatrix(vectors).computeGramianMatrix().toArray()
    return gram / n


def whiten(df: DataFrame, *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector and component (from 1, at most ``components``): ``id_col``, component, n, deviation,
    whitened, explained, identity_error.

    Vectors that are null, or hold null, NaN or infinite entries, are left out; so are those whose length isn't the most
    frequent one (of equally frequent lengths the greatest counts), and empty ones. n vectors with sums S remain:
    deviation is the exact sum of (n*x-S)**2 over a vector's dimensions, and a result beyond a long is an error.
    whitened is (x-S/n) on the component by the root of its variance; explained is that variance by the whole one;
    identity_error is the largest absolute entry of whitened's covariance less the identity.

    Components without variance (constant dimensions, fewer vectors than dimensions) have whitened null and explained 0,
    and don't enter identity_error, which is 0 if there are no others. Repeated rows and null ids are kept as they are,
    equal variances have any order, other columns are ignored, and an empty table gives an empty result. The driver holds
    matrices of the vectors' dimension squared.
    """
    spark = df.sparkSession
    prepare(spark)
    kind = df.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()
    every = keep_table(integer_rows(df, id_col=id_col, vector_col=vector_col).where(F.size("x") > 0), "integer-vectors")
    lengths = every.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    schema = f"id {kind}, deviation long, w array<double>"
    if lengths is None:
        rows, n, k, explained = spark.createDataFrame([], schema), 0, 0, []
        error = 0.0
    else:
        fit = every.where(F.size("x") == lengths.length)
        n, sums = _dimension_sums(fit)
        total = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums])
        # n * x - S is an integer; only the division by n rounds
        centred = F.zip_with("x", total, lambda x, s: (x.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("double") / n)
        covariance = _covariance(fit.select(centred.alias("c")), n)
        values, vectors = np.linalg.eigh(covariance)
        k = min(components, len(values))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        real = values > FLAT * max(values[0], 0.0)
        trace = float(np.trace(covariance))
        explained = [float(v / trace) if r else 0.0 for v, r in zip(values, real, strict=True)]
        scaled = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), np.nan)
        shared = spark.sparkContext.broadcast((n, sums, scaled))

        def project(frames):
            n, sums, scaled = shared.value
            for frame in frames:
                if not len(frame):
                    continue
                x = np.stack(frame["x"].to_numpy())
                small = n * max(int(np.abs(x).max()), 1) < 2**61 and max(map(abs, sums)) < 2**61
                exact = x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)
                if small and float(np.abs(exact).max()) ** 2 * x.shape[1] < 2**62:
                    deviation = (exact * exact).sum(1)
                else:
                    deviation = [sum(int(v) * int(v) for v in row) for row in exact]
                    if max(deviation) >= 2**63:
                        raise ArithmeticError("a deviation doesn't fit a long")
                w = (exact.astype(float) / n) @ scaled
                yield pd.DataFrame({"id": frame["id"], "deviation": np.array(deviation, np.int64), "w": list(w)})

        rows = keep_table(fit.mapInPandas(project, schema), "whitened-vectors")
        error = 0.0
        used = [int(c) for c in np.flatnonzero(real)]
        if used:
            means = rows.agg(*[F.avg(F.col("w")[c]).alias(f"m{c}") for c in used]).first()
            own = F.array(*[F.col("w")[c] - F.lit(float(means[f"m{c}"])) for c in used])
            error = float(np.abs(_covariance(rows.select(own.alias("c")), n) - np.eye(len(used))).max())
    made = rows.select(F.col("id").alias(id_col), "deviation", F.posexplode("w").alias("c", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained]) if k else F.array().cast("array<double>")
    return made.select(
        id_col, (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"), F.get(shares, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"),
    )
