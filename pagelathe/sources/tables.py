"""Where pages and schemas come from, and where rows go."""

from __future__ import annotations

import json
import tempfile
import uuid
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions.coerce import Field, validate
from pagelathe.functions.urls import crawl_url, follows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls(spark: SparkSession, path: str) -> DataFrame:
    """(ord, url) of a text file, without blank lines and comments."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def schema(text: str) -> list[Field]:
    """The fields of a JSON list of {field, type, example, hint}."""
    return validate([Field(x["field"], x["type"], x.get("example"), x.get("hint")) for x in json.loads(text)])


def archived(pages: DataFrame, archive: DataFrame, order: tuple[str, ...] = ("cache", "wayback", "amp", "reader")) -> DataFrame:
    """pages with the html of the first archive that has 800 characters, for those whose html is null."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    best = archive.where((F.length("html") >= 800) & (F.col("status_code") < 400) & (rank > 0)).groupBy("url").agg(F.min_by("html", rank).alias("__html"))
    return pages.join(best, "url", "left").withColumn("html", F.coalesce("html", "__html")).drop("__html")


def sitemap_urls(maps: DataFrame, glob: str | None = None) -> DataFrame:
    """(host, ord, url) of sitemaps (host, xml): the text of every loc in crawl form, each URL once; none of a map that is no XML."""

    @F.arrow_udf("array<string>")
    def locs(xml: pa.Array) -> pa.Array:
        out = []
        for x in xml.to_pylist():
            try:
                out.append([e.text.strip() for e in ElementTree.fromstring(x or "").iter() if e.tag.rpartition("}")[2] == "loc" and e.text])
            except ElementTree.ParseError:
                out.append([])
        return pa.array(out, pa.list_(pa.string()))

    found = maps.select("host", F.posexplode(locs("xml")).alias("ord", "raw")).select("host", "ord", crawl_url(F.col("raw")).alias("url"))
    found = found.where(follows(F.col("url"), glob)) if glob else found
    return found.groupBy("host", "url").agg(F.min("ord").alias("ord")).select("host", "ord", "url")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; a local one only where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = tempfile.mkdtemp(prefix="pagelathe-")
    return f"{base.rstrip('/')}/rows-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder: made once, however often they are read."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


#: Bytes of a page, and of an image, that are read at most.
PAGE_BYTES, IMAGE_BYTES = 10_000_000, 5_000_000
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif")


def decoded(files: DataFrame, cap: int = PAGE_BYTES) -> DataFrame:
    """(url, html) of files (path, content: binary) or responses (url, content[, charset]): the first bytes as text, what is no UTF-8 replaced."""

    @F.arrow_udf("string")
    def text(content: pa.Array, charset: pa.Array) -> pa.Array:
        out = []
        for raw, name in zip(content.to_pylist(), charset.to_pylist(), strict=True):
            try:
                out.append(None if raw is None else raw.decode(name or "utf-8", "replace"))
            except LookupError:
                out.append(raw.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    charset = F.col("charset") if "charset" in files.columns else F.lit(None).cast("string")
    url = F.col("url") if "url" in files.columns else F.col("path")
    return files.select(url.alias("url"), text(F.substring("content", 1, cap), charset).alias("html"))


def rendered(pages: DataFrame, snapshots: DataFrame, reason: str = "reason") -> DataFrame:
    """pages (url, html, reason) with the browser's html of snapshots (url, html) where a reason asks for it, and render_mode."""
    asks = F.col(reason) != "none"
    shots = snapshots.groupBy("url").agg(F.first("html").alias("__shot")).withColumnRenamed("url", "__url")
    rows = pages.join(shots, asks & (F.col("url") == F.col("__url")), "left")
    return rows.withColumn("html", F.coalesce("__shot", "html")).withColumn("render_mode", F.when(F.col("__shot").isNotNull(), "browser").otherwise("plain")).drop("__shot", "__url")


def embedded(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """(page_id, source, rank, ord, key, value) of oEmbed answers (endpoint, json) for pages (page_id, oembed): each key bare and under oembed."""
    hits = pages.where("oembed is not null").join(answers, F.col("oembed") == F.col("endpoint"))
    rows = hits.select("page_id", F.explode(F.from_json("json", "map<string,string>")).alias("k", "value")).where("value is not null")
    keys = rows.select("page_id", "value", F.explode(F.array(F.concat(F.lit("oembed."), "k"), F.col("k"))).alias("key"))
    return keys.select("page_id", F.lit("oembed").alias("source"), F.lit(8).alias("rank"), F.lit(0).alias("ord"), "key", "value")


def image_bytes(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates (image) with mime and bytes of files (url, mime, bytes): those that are small enough, unknown types as JPEG."""
    small = files.where(F.octet_length("bytes") <= IMAGE_BYTES)
    mime = F.when(F.lower("mime").isin(*IMAGE_TYPES), F.lower("mime")).otherwise("image/jpeg")
    return candidates.join(small.select(F.col("url").alias("__url"), mime.alias("mime"), "bytes"), F.col("image") == F.col("__url")).drop("__url")
