"""Pages as a stream: each content once within a watermark, and results that expire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(pages: DataFrame, ts: str = "ts", within: str = "10 minutes") -> DataFrame:
    """A stream of pages without repeats of url and content within the watermark."""
    return pages.withColumn("hash", F.sha2("html", 256)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["url", "hash"])


def host_counts(pages: DataFrame, host: str = "host", ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Pages and errors of each host in event-time windows; late rows count until the watermark passes."""
    rows = pages.withWatermark(ts, late).groupBy(F.window(ts, window), host)
    return rows.agg(F.count("*").alias("pages"), F.count_if(F.col("status") >= 400).alias("errors")).select("window.start", "window.end", host, "pages", "errors")


def upsert(target: str, keys: list[str], order: str, versions: int = 3):
    """A foreachBatch function: the latest row of each key, as a new version of the table at `target`.

    A batch adds its rows to the last finished version before it, whatever its number, and writes a version of its own; a
    batch that is run again writes the same one again. A version counts once it is finished (its _SUCCESS file), so readers of
    latest() see the one before until then. Versions older than the last few are deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _finished(spark, target) if v < batch_id]
        rows = spark.read.parquet(f"{target}/v{before[-1]:09d}").unionByName(batch) if before else batch
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), order).alias("x")).select("x.*")
        newest.write.mode("overwrite").parquet(f"{target}/v{batch_id:09d}")
        for old in before[: -max(1, versions - 1)]:
            _folder(spark, target)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{old:09d}"), True)

    return write


def latest(spark, target: str) -> DataFrame | None:
    """The last finished version of a table that upsert() writes; None before the first."""
    found = _finished(spark, target)
    return spark.read.parquet(f"{target}/v{found[-1]:09d}") if found else None


def _folder(spark, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _finished(spark, target: str) -> list[int]:
    fs, path = _folder(spark, target)
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)
