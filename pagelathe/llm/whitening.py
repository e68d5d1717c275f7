"""Whitening of embeddings by a tall-skinny QR: rows are centred by exact sums, each partition keeps only its factor R, and
factors of a few partitions merge until one is left. Its right singular vectors whiten; no covariance is ever formed.

The rows are read four times and never exchanged; what moves is one d x d factor for each partition, a sixteenth of them at the next
level, and so on. The driver gets the sums (d numbers), the last factor and one small matrix of moments.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.shared import rows_per_partition

#: x = floor(SCALE * c) + SHIFT; factors that merge at once; rows that are factorised at once.
SCALE, SHIFT, FAN, BLOCK = 1024, 100_000, 16, 4096
#: Largest x either way: the ends of a long, so that a huge entry saturates and is not lost.
MOST = (1 << 63) - 1
FACTOR = "node long, r binary"


@dataclass(frozen=True)
class Whitening:
    """Vectors fitted on, their sums by dimension, eigenvalues by falling size, eigenvectors (columns), the sum of all eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    wide: bool

    @property
    def d(self) -> int:
        return len(self.sums)


def usable(vector: str) -> Column:
    """Whether a vector is not null, not empty and has finite entries only."""
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(~bad, F.lit(False))


def scaled(vector: str) -> Column:
    """x of every entry, as long; what a long cannot hold is the end of its range."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.when(F.abs(c) < 8e15, F.floor(c * SCALE) + SHIFT).otherwise(F.when(c > 0, F.lit(MOST)).otherwise(F.lit(-MOST))))


def matrix(vectors: pa.Array) -> np.ndarray:
    values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    return values.reshape(len(vectors), -1)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...], wide: bool) -> np.ndarray:
    """n * x - S, exact: in long, or in integers of any size where a long might not hold it."""
    kind = object if wide else np.int64
    return x.astype(kind) * n - np.array(sums, kind)


def factor(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    """R of all rows one after another, at most d x d: what was read before is R, and the next rows go below it."""
    r = np.zeros((0, d))
    for rows in blocks:
        r = np.linalg.qr(np.concatenate([r, rows]), mode="r")
    return r


def row_factors(rows: DataFrame, n: int, sums: tuple[int, ...], wide: bool) -> DataFrame:
    """(node, r): the factor of the centred rows of each partition."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        blocks = (centred(matrix(b.column("x").slice(at, BLOCK)), n, sums, wide).astype(np.float64) / n for b in batches for at in range(0, b.num_rows, BLOCK))
        r = factor(blocks, d)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.tobytes()])], names=["node", "r"])

    return rows.select("x").mapInArrow(run, FACTOR)


def merged(factors: DataFrame, d: int, leaves: int) -> np.ndarray:
    """One factor of all: FAN of them at a time, level by level, until FAN at most are left for the driver, d x d each."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        order = table.column("leaf").to_numpy().argsort()
        raw = table.column("r").to_pylist()
        r = factor((np.frombuffer(raw[i]).reshape(-1, d) for i in order), d)
        return pa.table({"node": pa.array([node], pa.int64()), "r": pa.array([r.tobytes()])})

    while leaves > FAN:
        factors = factors.select(F.shiftright("node", 4).alias("node"), F.col("node").alias("leaf"), "r").groupBy("node").applyInArrow(run, FACTOR)
        leaves = -(-leaves // FAN)
    last = sorted(factors.collect(), key=lambda row: row["node"])
    return factor((np.frombuffer(bytes(row["r"])).reshape(-1, d) for row in last), d)


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of rows (x: array<long> of one length); None if there are none."""
    each = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.max(F.abs(F.col("x").cast("decimal(38,0)"))).alias("most"))
    found = each.orderBy("i").collect()  # a row for each dimension
    if not found:
        return None
    n, sums = found[0]["n"], tuple(int(r["s"]) for r in found)
    d = len(sums)
    spread = max(n * int(r["most"]) + abs(s) for r, s in zip(found, sums, strict=True))
    wide = spread >= 1 << 62
    r = merged(row_factors(rows, n, sums, wide), d, max(1, rows.rdd.getNumPartitions()))
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    values = s**2 / n
    # below this a direction holds rounding only: its variance is zero, and nothing can be divided by it
    real = s > max(s[0], 1.0) * max(n, d) * np.finfo(float).eps if len(s) else np.zeros(0, bool)
    return Whitening(n, sums, values[real], vt[real].T.copy(), float(values.sum()), wide)


def projected(y: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    return (y.astype(np.float64) / model.n) @ (model.vectors[:, :k] / np.sqrt(model.values[:k]))


def identity_error(rows: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity: a second pass, moments merged about the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, about = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                w = projected(centred(matrix(b.column("x").slice(at, BLOCK)), model.n, model.sums, model.wide), model, k)
                n, mean, about = joined((n, mean, about), moments(w))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([about.tobytes()])], names=["n", "mean", "about"])

    def merge(table: pa.Table) -> pa.Table:
        n, mean, about = 0, np.zeros(k), np.zeros((k, k))
        for m, a, b in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "about")), strict=True):
            n, mean, about = joined((n, mean, about), (m, np.frombuffer(a), np.frombuffer(b).reshape(k, k)))
        return pa.table({"n": pa.array([n]), "mean": pa.array([mean.tobytes()]), "about": pa.array([about.tobytes()])})

    schema = "n long, mean binary, about binary"
    parts = rows.select("x").mapInArrow(run, schema).withColumn("node", F.pmod(F.xxhash64("mean"), F.lit(FAN)))
    some = parts.groupBy("node").applyInArrow(lambda t: merge(t.drop_columns("node")), schema)
    n, mean, about = 0, np.zeros(k), np.zeros((k, k))
    for row in sorted(some.collect(), key=lambda row: (row["n"], bytes(row["mean"]))):  # FAN at most, k x k each
        n, mean, about = joined((n, mean, about), (row["n"], np.frombuffer(bytes(row["mean"])), np.frombuffer(bytes(row["about"])).reshape(k, k)))
    return float(np.abs(about / n - np.eye(k)).max()) if n and k else 0.0


def moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def joined(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and products about the mean of two lots of rows together."""
    n = a[0] + b[0]
    if not n:
        return a
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


OUT = "deviation decimal(38,0), whitened array<double>"


def whiten(vectors: DataFrame, vector: str = "embedding", k: int = 8) -> tuple[DataFrame, Whitening | None, float]:
    """(rows, model, identity error): the rows of `vectors` that can be used, with `deviation` and up to k `whitened` coordinates.

    Rows whose vector is null, empty or has a null or non-finite entry are dropped. If lengths differ, the commonest length
    (of those as common, the longest) is fitted and returned, and rows of other lengths are dropped: they are points of
    another space. deviation is exact: the squared distance from the mean, times n squared. Directions without variance
    are no components, so fewer than k come back if vectors span less; equal vectors only: no component, an empty array. Ties of
    eigenvalues: any orthonormal basis of their space. Repeated rows count each. Empty table: no rows, model None. Other
    columns are kept; names that clash with the two new ones are replaced.
    """
    sizes = vectors.where(usable(vector)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    other = [c for c in vectors.columns if c not in ("deviation", "whitened")]
    held = vectors.where(usable(vector) & (F.size(vector) == d)).select(*[F.col(f"`{c}`") for c in other])
    bare = held.select(scaled(vector).alias("x"))
    model = fit(bare)
    if model is None:
        return held.select("*", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")).where(F.lit(False)), None, 0.0
    k = min(k, len(model.values))
    error = identity_error(bare, model, k)

    @F.arrow_udf(f"struct<{OUT.replace('deviation ', 'deviation:').replace('whitened ', 'whitened:')}>")
    def both(x: pa.Array) -> pa.Array:
        dev, white = [], np.zeros((len(x), k))
        for at in range(0, len(x), BLOCK):
            y = centred(matrix(x.slice(at, BLOCK)), model.n, model.sums, model.wide)
            most = int(np.abs(y).max()) if y.size else 0
            exact = y if most * most * model.d < 1 << 62 else y.astype(object)
            dev += [decimal.Decimal(int(v)) for v in (exact * exact).sum(axis=1)]
            white[at : at + len(y)] = projected(y, model, k)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(white.ravel()))
        fits = [v if v < 10**38 else None for v in dev]
        return pa.StructArray.from_arrays([pa.array(fits, pa.decimal128(38, 0)), flat], names=["deviation", "whitened"])

    return held.withColumn("__both", both(scaled(vector))).select(*[F.col(f"`{c}`") for c in other], "__both.deviation", "__both.whitened"), model, error


def components(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component; see whiten().

    deviation as long; null where a long cannot hold it.
    """
    rows, model, error = whiten(vectors.select(key, vector), vector, k)
    share = [] if model is None else [float(v / model.trace) for v in model.values[:k]]
    return rows.select(key, F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("component", "whitened")).select(
        key,
        (F.col("component") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        (F.element_at(F.array(*[F.lit(v) for v in share]), F.col("component") + 1) if share else F.lit(0.0)).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


__all__ = ["Whitening", "components", "fit", "rows_per_partition", "whiten"]
