"""One page, a batch in its order, a crawl with its counters: what the entry points and the command line call."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions.coerce import Field
from pagelathe.functions.urls import cache_url, crawl_url, host, part, url_safety
from pagelathe.operators import cache, crawl
from pagelathe.plans import engine
from pagelathe.plans.chain import Sources, gathered
from pagelathe.plans.provider import Provider
from pagelathe.sources.tables import written


def extract_one(spark: SparkSession, url: str, html: str | None, fields: list[Field], provider: Provider | None = None) -> dict:
    """The result row of one page, as a dictionary."""
    page = spark.createDataFrame([(0, url, html)], "page_id long, url string, html string")
    return engine.extract(page, fields, provider).first().asDict(recursive=True)


class BatchFailed(RuntimeError):
    """A batch that must not have failures has one."""


def extract_from(requests: DataFrame, sources: Sources, fields: list[Field], provider: Provider | None = None, now=None, fail_fast: bool = False) -> DataFrame:
    """(ordinal, url, status, data, warnings, error, source, via) for each of requests (ordinal, url): the whole chain, from refusing hosts to the last call.

    Pages come by chain.gathered(), cleaned texts and values that the caches of `sources` have are not made again, oEmbed answers are facts. With fail_fast the rows
    are written once, and a failed one raises BatchFailed with the first failure in order; what is returned is what was written.
    """
    now = F.current_timestamp() if now is None else now
    rows = gathered(requests, sources, now, any(f.type in ("integer", "float") for f in fields))
    if sources.texts is not None:
        live = sources.texts.where(F.col("expires_at") > now).groupBy(F.col("hash").alias("__hash")).agg(F.max("text").alias("cleaned"))
        rows = rows.join(live, F.sha2("html", 256) == F.col("__hash"), "left").drop("__hash")
    if sources.fields is not None:
        known = cache.field_lookup(rows.select(cache_url(F.col("url")).alias("url_key")).distinct(), sources.fields, fields, now)
        rows = rows.join(known.select(F.col("url_key").alias("__key"), F.col("known").alias("cached")), cache_url(F.col("url")) == F.col("__key"), "left").drop("__key")
    done = engine.extract(rows, fields, provider, carry=("ordinal", "via"), embeds=sources.embeds).drop("page_id")
    if not fail_fast:
        return done
    done = written(done)
    first = done.where("status = 'error'").agg(F.min_by("error", "ordinal"), F.min("ordinal")).first()
    if first[1] is not None:
        raise BatchFailed(f"request {first[1]}: {first[0]['code']}")
    return done


def observed(results: DataFrame, name: str = "extract") -> tuple[DataFrame, Observation]:
    """results with counters that are there once they have been read, without a job of their own: rows, failures and rows by source."""
    seen = Observation(name)
    of = lambda s: F.count_if(F.col("source") == s).alias(s)
    counted = results.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "error").alias("failed"), F.sum(F.size("warnings")).alias("warnings"), *[of(s) for s in ("metadata", "metadata_partial", "provider", "fallback")])
    return counted, seen


def batch(requests: DataFrame, pages: DataFrame, fields: list[Field], provider: Provider | None = None, cached: DataFrame | None = None, now=None, fail_fast: bool = False) -> DataFrame:
    """A row for each of requests (ordinal, url), whatever repeats or lacks a page: (ordinal, url, status, data, warnings, error, source).

    Requests with an unexpired row in `cached` (url_key, payload, expires_at) are done; the others go through one pass over their
    pages (page_id, url, html), and results come back by ordinal. URLs that must not be fetched are error rows. With fail_fast a
    failed page raises BatchFailed, with the first failure in order.
    """
    from pagelathe.functions.coerce import row_type
    from pagelathe.functions.classify import error_row

    asked = requests.select("ordinal", "url", cache_url(F.col("url")).alias("url_key"))
    now = F.current_timestamp() if now is None else now
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, status, data, code, source: df.select("ordinal", "url", F.lit(status).alias("status"), data.alias("data"), F.array().cast("array<string>").alias("warnings"), error_row(code).alias("error"), F.lit(source).cast("string").alias("source"))
    parts = []
    if cached is not None:
        hits, asked = cache.fresh(asked, cached.select("url_key", "payload", "expires_at"), ["url_key"], now)
        parts.append(row(hits, "success", F.from_json("payload", row_type(fields)), none("string"), "cache"))
    unsafe = url_safety(F.col("url")) != "ok"
    parts.append(row(asked.where(unsafe), "error", none(row_type(fields)), F.lit("URL_UNREACHABLE"), None))
    asked = asked.where(~unsafe)
    one = pages.groupBy(crawl_url(F.col("url")).alias("key")).agg(F.max_by(F.struct("page_id", "html"), "page_id").alias("page"))
    found = asked.join(one, crawl_url(F.col("url")) == F.col("key"), "left")
    parts.append(row(found.where("page is null"), "error", none(row_type(fields)), F.lit("URL_UNREACHABLE"), None))
    here = found.where("page is not null").select("page.page_id", "url", "page.html", "ordinal")
    done = engine.extract(here, fields, provider, carry=("ordinal",)).drop("page_id")
    for p in parts:
        done = done.unionByName(p)
    if fail_fast:
        done = written(done)  # asked once: what is tested is what is returned
        first = done.where("status = 'error'").agg(F.min_by("error", "ordinal"), F.min("ordinal")).first()
        if first[1] is not None:
            raise BatchFailed(f"request {first[1]}: {first[0]['code']}")
    return done


def crawl_pages(pages: DataFrame, edges: DataFrame, seeds: DataFrame, fields: list[Field], provider: Provider | None = None, max_depth: int = 2, max_pages: int | None = None, glob: str | None = None, robots: DataFrame | None = None, sitemaps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, counters) of a crawl: first the levels of links are discovered, then all pages found go through one pass.

    Seeds are those given and the URLs of sitemaps (host, url) of their hosts. Pages that robots rules forbid are skipped, and
    those without a page are failed. results: as batch(), with depth. counters: pages_visited, pages_skipped, pages_failed.
    """
    if sitemaps is not None:
        hosts = seeds.select(host(F.col("url")).alias("h")).distinct()
        seeds = seeds.select("url").unionByName(sitemaps.join(hosts, F.col("host") == F.col("h"), "left_semi").select("url")).distinct()
    reached = crawl.crawl(edges, seeds, max_depth, max_pages, glob)
    places = reached.select("url", "depth", host(F.col("url")).alias("host"), part(F.col("url"), 3).alias("path"))
    if robots is not None:
        places = crawl.allowed(places.select("url", "host", "path"), crawl.robots_rules(robots)).join(places.select(F.col("url").alias("u"), "depth"), F.col("url") == F.col("u")).drop("u")
    else:
        places = places.withColumn("allowed", F.lit(True))
    requests = places.where("allowed").select(F.xxhash64("url").alias("ordinal"), "url", "depth")
    rows = batch(requests, pages, fields, provider).join(requests.select(F.col("ordinal").alias("o"), "depth"), F.col("ordinal") == F.col("o")).drop("o", "ordinal")
    skipped = places.agg(F.count_if(~F.col("allowed")).alias("pages_skipped"))
    counted = rows.agg(F.count_if(F.col("status") == "success").alias("pages_visited"), F.count_if(F.col("status") == "error").alias("pages_failed"))
    return rows, counted.crossJoin(skipped).select("pages_visited", "pages_skipped", "pages_failed")


def within(seconds: float, spark: SparkSession, work, group: str = "pagelathe-deadline"):
    """What work() returns, or None if it takes longer: its Spark jobs are cancelled at the deadline."""
    import threading

    ends, done = time.monotonic() + seconds, threading.Event()
    context = spark.sparkContext
    context.addJobTag(group)

    def watch() -> None:
        if not done.wait(max(0.0, ends - time.monotonic())):
            context.cancelJobsWithTag(group)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return work()
    except Exception:
        if time.monotonic() >= ends:
            return None
        raise
    finally:
        done.set()
        context.removeJobTag(group)
