"""What the operators share: tables in the shared folder, slices of text, skew-safe prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of most contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at once by an Arrow function; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor sees. A local one only if the setting is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = tempfile.mkdtemp(prefix="pagelathe-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/pagelathe-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _discard_all() -> None:
    for spark, path in _made:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and its folder is the cluster's to clean
            return


atexit.register(_discard_all)


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: what follows does not depend on its lineage."""
    path = shared_dir(df.sparkSession) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, at most: of whole texts (with long ones Spark's limit on bytes comes first), of keys.
TEXT_ROWS, KEY_ROWS = 1000, 10_000


def arrow_rows(spark: SparkSession, most: int) -> None:
    """Sets the session's spark.sql.execution.arrow.maxRecordsPerBatch for the next Arrow function, unless the user has set it.

    It is read when a plan runs, so it cannot be put back here. It bounds memory only: no result depends on where batches end.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) in ("10000", str(TEXT_ROWS), str(KEY_ROWS)):  # Spark's default, or ours
        spark.conf.set(name, str(most))


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of df, to be read by an Arrow function in batches that fit beside an executor's heap."""
    arrow_rows(df.sparkSession, TEXT_ROWS)
    return df.select(*columns) if columns else df


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back: workers are used again, by other stages too."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c: Column) -> Column:
    """Number of words, without leaving the JVM: the starts of words are what is left of the text."""
    t = F.coalesce(c, F.lit(""))
    return F.length(F.regexp_replace(F.regexp_replace(t, WORD, "w"), r"[\x20\x09-\x0D]+", "")).cast("long")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in pieces of about `limit` bytes of text, in order, whole rows only."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts after one another, and the n + 1 offsets; null is empty."""
    a = pc.fill_null(texts, "").cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offs = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


#: By byte: whether it belongs to a word as WORD has it.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray = IN_WORD, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the number of words before each text and after the last. inside: by place, instead of table, by byte."""
    w = table[data] if inside is None else inside
    before = np.empty_like(w)
    before[1:], before[:1] = w[:-1], False
    after = np.empty_like(w)
    after[:-1], after[-1:] = w[1:], False
    inner = offs[1:-1]
    before[inner[inner < len(w)]] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word and the distinct words by number."""
    size = ends - starts
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    np.add.at(mark, ends, -1) if len(ends) < 64 else mark.__setitem__(ends, mark[ends] - 1)
    body = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(body))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def rows_per_partition(df: DataFrame, least: int = 12) -> int:
    """A number of partitions or buckets that grows with the input: its own number of partitions, `least` at least."""
    return max(least, df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def prefix_sum(df: DataFrame, keys: list[str], value: Column, order: list[Column], out: str, buckets: int) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same keys that come earlier.

    Rows come by a hash of `order`, then by `order`, whatever `buckets` is: a bucket is a range of the hash. A key's rows are dealt over all buckets, so that no
    task gets a key whole; the buckets' totals (keys x buckets rows) are summed apart and joined back. Rows that
    agree in all of `order` must agree in `value`: they are interchangeable.
    """
    b, part, total = "__bucket", "__part", "__base"
    hashed = F.xxhash64(*order, F.lit(17))
    df = df.withColumn(b, F.shiftright((F.shiftright(hashed, 32) + F.lit(1 << 31)) * F.lit(buckets), 32).cast("int"))
    sums = df.groupBy(*keys, b).agg(F.sum(value).alias(part))
    w = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, b, F.coalesce(F.sum(part).over(w), F.lit(0)).alias(total))
    inner = Window.partitionBy(*keys, b).orderBy(hashed, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(part, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [rows[k].eqNullSafe(sums[k]) for k in keys] + [rows[b] == sums[b]]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return rows.join(sums, cond, "left").select(*[rows[c] for c in df.columns if c != b], (rows[part] + sums[total]).alias(out))


#: Bits of screened()'s filter; as 64-bit words they are 2 ** 20 rows at most, whatever the number of keys.
FILTER_BITS = 1 << 26


def screened(rows: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose `column` (long) may be among the keys, and those where it is not, for sure.

    A filter with one bit for each key: a join with its words, which are broadcast. Of the rows that are not among n keys, n / FILTER_BITS
    come with the first lot too, in the end all of them: it only spares rows an exchange, so an exact join must follow. All of it
    is in the JVM, and the same at every size. Both lots scan rows, so these should be a table or columns of one. Null: not among the keys.
    """
    place = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(11), c), 64 - FILTER_BITS.bit_length() + 1)
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))
    words = keys.select(place(F.col(key)).alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(bit(F.col("p"))).alias("__mask"))
    at = place(F.col(column))
    looked = rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col("__word"), "left")
    hit = F.coalesce(F.col("__mask").bitwiseAND(bit(at)) != 0, F.lit(False)) & F.col(column).isNotNull()
    return looked.where(hit).drop("__word", "__mask"), looked.where(~hit).drop("__word", "__mask")
