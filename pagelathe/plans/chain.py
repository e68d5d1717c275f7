"""Where a page comes from: the plain answer, a rendered snapshot, an archive, or nowhere; one pass of equi-joins over all requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.classify import escalation_reason, is_hard_block
from pagelathe.functions.urls import crawl_url, host, url_safety
from pagelathe.operators import cache
from pagelathe.sources import tables

#: Characters of a page that are read at most.
PAGE_CHARS = 10_000_000


@dataclass(frozen=True)
class Sources:
    """Tables that pages come from. Only `pages` must be there.

    pages: url, html[, page_id, status_code, headers]; snapshots: url, html, of a browser; archive: url, source, html, status_code; marks: host, ts, of hosts that
    refused a short time ago; embeds: endpoint, json, oEmbed answers; texts: hash, text, expires_at, cleaned texts; fields: url_key, field, type, value, expires_at.
    """

    pages: DataFrame
    snapshots: DataFrame | None = None
    archive: DataFrame | None = None
    marks: DataFrame | None = None
    embeds: DataFrame | None = None
    texts: DataFrame | None = None
    fields: DataFrame | None = None


def gathered(requests: DataFrame, sources: Sources, now: Column | None = None, numeric: bool = False) -> DataFrame:
    """requests (ordinal, url) with page_id, html, status_code, headers, via and code: each with the page of the first source that has a good one.

    via: plain, browser (a snapshot, where the plain answer asks for one), archive (where there is no page or it stays a block page), or null with a code: URL_UNREACHABLE
    for what must not be fetched or is nowhere, FETCH_BLOCKED for hosts that refused a short time ago and for pages that stay blocked. Of several
    rows of a URL the one with the largest page_id counts. html is cut at PAGE_CHARS characters. Null url: URL_UNREACHABLE. Repeated requests come back each.
    """
    now = F.current_timestamp() if now is None else now
    rows = requests.select("ordinal", "url", crawl_url(F.col("url")).alias("__key"), F.lower(host(F.col("url"))).alias("__host"))
    unsafe = F.coalesce(url_safety(F.col("url")) != "ok", F.lit(True))
    rows = rows.withColumn("code", F.when(unsafe, "URL_UNREACHABLE"))
    if sources.marks is not None:
        shut = cache.blocked_hosts(sources.marks, now).select(F.col("host").alias("__shut"))
        rows = rows.join(shut, F.col("__host") == F.col("__shut"), "left").withColumn("code", F.coalesce("code", F.when(F.col("__shut").isNotNull(), "FETCH_BLOCKED"))).drop("__shut")
    given = sources.pages
    part = lambda name, kind: F.col(name).cast(kind) if name in given.columns else F.lit(None).cast(kind)
    page = F.struct(part("page_id", "long").alias("page_id"), F.substring("html", 1, PAGE_CHARS).alias("html"), part("status_code", "int").alias("status_code"), part("headers", "map<string,string>").alias("headers"))
    one = given.groupBy(crawl_url(F.col("url")).alias("__k")).agg(F.max_by(page, F.coalesce(part("page_id", "long"), F.lit(0))).alias("p"))
    rows = rows.join(one, F.col("code").isNull() & (F.col("__key") == F.col("__k")), "left").select("ordinal", "url", "__key", "code", "p.*")
    status = F.coalesce("status_code", F.lit(200))
    rows = rows.withColumn("reason", F.when(F.col("html").isNotNull(), escalation_reason(F.col("html"), status, numeric)).otherwise("none"))
    rows = rows.withColumn("render_mode", F.lit("plain"))
    if sources.snapshots is not None:
        shots = sources.snapshots.select(crawl_url(F.col("url")).alias("url"), F.substring("html", 1, PAGE_CHARS).alias("html"))
        rows = tables.rendered(rows.withColumnRenamed("url", "__asked").withColumnRenamed("__key", "url"), shots).withColumnRenamed("url", "__key").withColumnRenamed("__asked", "url")
    # what a browser has seen is judged without the plain answer's status
    seen = F.when(F.col("render_mode") == "browser", 200).otherwise(status)
    stays = F.coalesce(is_hard_block(F.col("html"), seen), F.lit(False))
    rows = rows.withColumn("__shut", stays).withColumn("html", F.when(~stays, F.col("html")))
    rows = rows.withColumn("__here", F.col("html").isNotNull())
    if sources.archive is not None:
        old = sources.archive.withColumn("url", crawl_url(F.col("url")))
        asks = rows.withColumnRenamed("url", "__asked").withColumn("url", F.when(F.col("code").isNull() & ~F.col("__here"), F.col("__key")))
        rows = tables.archived(asks, old).drop("url").withColumnRenamed("__asked", "url")
    via = F.when(F.col("code").isNotNull() | F.col("html").isNull(), F.lit(None)).when(~F.col("__here"), "archive").otherwise(F.col("render_mode"))
    lost = F.when(F.col("html").isNull(), F.when(F.col("__shut"), "FETCH_BLOCKED").otherwise("URL_UNREACHABLE"))
    return rows.withColumn("via", via).withColumn("code", F.coalesce("code", lost)).select("ordinal", "url", "page_id", "html", F.when(F.col("via") == "plain", F.col("status_code")).alias("status_code"), "headers", "via", "code")


def marks_after(results: DataFrame, marks: DataFrame | None, now: Column) -> DataFrame:
    """(host, ts) of hosts that refused, after results (url, code): a blocked page marks its host, a page that came clears it."""
    rows = results.select(F.lower(host(F.col("url"))).alias("host"), (F.col("code") == "FETCH_BLOCKED").alias("shut"), F.col("code").isNull().alias("came")).where("host != ''")
    by_host = rows.groupBy("host").agg(F.bool_or("shut").alias("shut"), F.bool_or("came").alias("came"))
    new = by_host.where("shut and not came").select("host", now.alias("ts"))
    if marks is None:
        return new
    old = marks.select("host", "ts").join(by_host.where("came or shut").select(F.col("host").alias("h")), F.col("host") == F.col("h"), "left_anti")
    return old.unionByName(new)
