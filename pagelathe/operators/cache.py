"""Results that stay fresh for a while, as keyed tables with an expiry."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.coerce import Field
from pagelathe.functions.urls import VOLATILE, cache_url, field_ttl, ttl_seconds


def schema_key(fields: list[Field]) -> str:
    """What a schema asks for, whatever the order of its fields; hints and examples do not count."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(f"{f.name}\t{f.type}" for f in fields)).encode()).hexdigest()[:32]


def fresh(requests: DataFrame, cache: DataFrame, on: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests: an equi-join with the unexpired entries, and the anti join."""
    live = cache.where(F.col("expires_at") > now)
    return requests.join(live, on), requests.join(live.select(*on), on, "left_anti")


def write_policy(nulls: Column, total: Column, ttl: Column) -> tuple[Column, Column]:
    """(whether a row is stored, its seconds): small schemas only without nulls, others up to two fifths of nulls."""
    store = F.when(total <= 4, nulls == 0).otherwise(nulls <= 0.4 * total)
    return store, F.when(nulls > 0, F.least(F.floor(ttl / 2), F.lit(3600))).otherwise(ttl).cast("int")


def cacheable(field: Column, value: Column) -> Column:
    """A value worth keeping: there, not blank, of a field that does not change by the hour."""
    return value.isNotNull() & (F.trim(value) != "") & ~field.rlike(VOLATILE)


def blocked_hosts(marks: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Hosts (host) marked (host, ts) within the last `seconds`."""
    return marks.where(F.col("ts") > now - F.make_interval(secs=F.lit(seconds))).select("host").distinct()


def overlay(*layers: Column) -> Column:
    """The first layer's value that is there."""
    return F.coalesce(*layers)


def once_per_content(pages: DataFrame, work, key: str = "html") -> DataFrame:
    """work(distinct content) joined back to all pages: equal content is worked on once.

    work: DataFrame (hash, content) -> DataFrame (hash, ...).
    """
    hashed = pages.withColumn("hash", F.sha2(F.col(key), 256))
    distinct = hashed.groupBy("hash").agg(F.first(key).alias(key))
    return hashed.drop(key).join(work(distinct), "hash")


#: Bytes of a field value, and of a cleaned text, that are kept at most; seconds that a cleaned text is.
FIELD_BYTES, TEXT_BYTES, TEXT_SECONDS = 16_000, 250_000, 1800


def result_rows(results: DataFrame, fields: list[Field], now: Column) -> DataFrame:
    """(schema_key, url_key, payload, expires_at) of results (url, status, data) that are worth keeping, by the write policy."""
    nulls = sum((F.col(f"data.`{f.name}`").isNull().cast("int") for f in fields), F.lit(0))
    volatile = any(re.search(VOLATILE, f.name) for f in fields)
    store, seconds = write_policy(nulls, F.lit(len(fields)), ttl_seconds(F.col("url"), F.lit(volatile)))
    rows = results.where(F.col("status") == "success").where(store)
    until = now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return rows.select(F.lit(schema_key(fields)).alias("schema_key"), cache_url(F.col("url")).alias("url_key"), F.to_json("data").alias("payload"), until.alias("expires_at"))


def field_rows(results: DataFrame, fields: list[Field], page_ttl: Column, now: Column, halve: Column | None = None, source: str = "provider") -> DataFrame:
    """(url_key, field, type, value, source, expires_at): a row for each value of results (url, data) that is worth keeping."""
    halve = F.lit(False) if halve is None else halve
    each = [F.struct(F.lit(f.name).alias("field"), F.lit(f.type).alias("type"), (F.to_json(F.col(f"data.`{f.name}`")) if f.type.startswith("array<") else F.col(f"data.`{f.name}`").cast("string")).alias("value")) for f in fields]
    rows = results.select(F.coalesce(cache_url(F.when(F.col("url").contains("://"), F.col("url"))), F.col("url")).alias("url_key"), page_ttl.alias("ttl"), halve.alias("halve"), F.explode(F.array(*each)).alias("x")).select("url_key", "ttl", "halve", "x.*")
    rows = rows.where(cacheable(F.col("field"), F.col("value")) & (F.octet_length("value") <= FIELD_BYTES))
    until = now + F.make_dt_interval(secs=field_ttl(F.col("field"), F.col("ttl"), F.col("halve")).cast("decimal(18,6)"))
    return rows.select("url_key", "field", "type", "value", F.lit(source).alias("source"), until.alias("expires_at"))


def field_lookup(requests: DataFrame, rows: DataFrame, fields: list[Field], now: Column) -> DataFrame:
    """requests (url_key) with `known`, a map of the unexpired values of the fields: one equi-join with the rows grouped by URL."""
    wanted = F.struct("field", "type").isin(*[F.struct(F.lit(f.name), F.lit(f.type)) for f in fields])
    live = rows.where((F.col("expires_at") > now) & wanted & ~F.col("field").rlike(VOLATILE))
    live = live.groupBy("url_key", "field").agg(F.max_by("value", "expires_at").alias("value"))
    by_url = live.groupBy("url_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("known"))
    return requests.join(by_url, "url_key", "left").withColumn("known", F.coalesce("known", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def text_rows(cleaned: DataFrame, now: Column) -> DataFrame:
    """(hash, text, expires_at) of cleaned texts (hash, text) that are short enough to keep."""
    return cleaned.where(F.octet_length("text") <= TEXT_BYTES).select("hash", "text", (now + F.make_dt_interval(secs=F.lit(TEXT_SECONDS).cast("decimal(18,6)"))).alias("expires_at"))
