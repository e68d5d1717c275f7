"""Embedded metadata: flattened facts, merged by source, resolved to declared fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.coerce import Field, coerce
from pagelathe.operators.outline import outlined

#: Rank of each source of facts: the lower one wins.
SOURCES = ("json-ld", "microdata", "microformat", "rdfa", "opengraph", "card", "meta", "header", "oembed")
#: Response headers that are read (fixed values).
HEADERS = ("last-modified", "content-language", "content-type")
# Keys that may hold a field, the better first, by the field's lower-case name; results must equal those of other readers.
ALIASES = {
    "title": ("name", "headline", "title", "og:title", "twitter:title"),
    "name": ("name", "title", "og:title", "twitter:title"),
    "headline": ("headline", "name", "title", "og:title", "twitter:title"),
    "price": ("price", "offers.price", "lowPrice", "product:price:amount"),
    "lowprice": ("lowPrice", "offers.lowPrice", "price"),
    "highprice": ("highPrice", "offers.highPrice"),
    "author": ("author", "author.name", "creator", "creator.name", "byline", "twitter:creator", "article:author", "dc.creator", "dc:creator", "meta.author"),
    "description": ("description", "og:description", "summary", "twitter:description", "meta.description"),
    "image": ("image", "og:image", "thumbnailUrl", "image.url", "twitter:image", "twitter:image:src"),
    "date": ("datePublished", "dateCreated", "uploadDate", "article:published_time", "meta.pubdate", "meta.date"),
    "published": ("datePublished", "article:published_time", "uploadDate", "meta.pubdate"),
    "publisheddate": ("datePublished", "article:published_time", "uploadDate", "header.last-modified"),
    "modified": ("dateModified", "article:modified_time", "lastModified", "header.last-modified"),
    "lastmodified": ("dateModified", "article:modified_time", "lastModified", "header.last-modified"),
    "updated": ("dateModified", "article:modified_time", "lastModified", "header.last-modified"),
    "category": ("category", "articleSection", "genre", "article:section"),
    "brand": ("brand", "brand.name", "product:brand"),
    "sku": ("sku", "productID", "mpn"),
    "gtin": ("gtin", "gtin13", "gtin12", "gtin8", "gtin14"),
    "isbn": ("isbn",),
    "mpn": ("mpn", "productID"),
    "currency": ("priceCurrency", "offers.priceCurrency", "product:price:currency"),
    "rating": ("aggregateRating.ratingValue", "ratingValue"),
    "ratingvalue": ("aggregateRating.ratingValue", "ratingValue"),
    "ratingcount": ("aggregateRating.ratingCount", "ratingCount", "aggregateRating.reviewCount"),
    "reviewcount": ("aggregateRating.reviewCount", "reviewCount", "aggregateRating.ratingCount"),
    "bestrating": ("aggregateRating.bestRating", "bestRating"),
    "worstrating": ("aggregateRating.worstRating", "worstRating"),
    "availability": ("offers.availability", "availability", "product:availability"),
    "instock": ("offers.availability", "availability", "product:availability"),
    "stock": ("offers.availability", "availability", "product:availability"),
    "tags": ("keywords", "article:tag", "meta.keywords", "meta.news_keywords"),
    "keywords": ("keywords", "meta.keywords", "meta.news_keywords"),
    "breadcrumbs": ("breadcrumb.itemListElement", "breadcrumb"),
    "breadcrumb": ("breadcrumb.itemListElement", "breadcrumb"),
    "publisher": ("publisher.name", "og:site_name", "twitter:site"),
    "source": ("publisher.name", "og:site_name", "twitter:site"),
    "language": ("inLanguage", "og:locale", "meta.language", "header.content-language", "html.lang"),
    "lang": ("inLanguage", "og:locale", "meta.language", "header.content-language", "html.lang"),
    "locale": ("og:locale", "inLanguage", "header.content-language"),
    "wordcount": ("wordCount",),
    "readingtime": ("timeRequired",),
    "email": ("email", "contactPoint.email", "publisher.email", "author.email"),
    "phone": ("telephone", "contactPoint.telephone", "publisher.telephone"),
    "address": ("address.streetAddress", "address", "publisher.address.streetAddress"),
    "country": ("address.addressCountry", "publisher.address.addressCountry"),
    "city": ("address.addressLocality", "publisher.address.addressLocality"),
    "region": ("address.addressRegion", "publisher.address.addressRegion"),
    "postal": ("address.postalCode", "publisher.address.postalCode"),
    "postalcode": ("address.postalCode", "publisher.address.postalCode"),
    "latitude": ("geo.latitude", "latitude"),
    "longitude": ("geo.longitude", "longitude"),
    "lat": ("geo.latitude", "latitude"),
    "lon": ("geo.longitude", "longitude"),
    "lng": ("geo.longitude", "longitude"),
    "url": ("url", "og:url", "twitter:url"),
    "canonical": ("url", "og:url"),
    "site": ("og:site_name", "twitter:site", "publisher.name"),
    "sitename": ("og:site_name", "twitter:site", "publisher.name"),
    "video": ("og:video", "og:video:url", "twitter:player"),
    "videourl": ("og:video", "og:video:url", "contentUrl", "embedUrl"),
    "embedurl": ("embedUrl", "og:video:url", "twitter:player"),
    "duration": ("duration", "video.duration"),
    "copyright": ("copyrightHolder.name", "copyrightNotice", "meta.copyright"),
    "cookminutes": ("cookTime", "totalTime"),
    "cooktime": ("cookTime", "totalTime"),
    "prepminutes": ("prepTime",),
    "preptime": ("prepTime",),
    "totalminutes": ("totalTime", "cookTime"),
    "totaltime": ("totalTime", "cookTime"),
    "ingredients": ("recipeIngredient", "ingredients"),
    "recipeingredient": ("recipeIngredient", "ingredients"),
    "servings": ("recipeYield", "yield"),
    "recipeyield": ("recipeYield", "yield"),
    "yield": ("recipeYield", "yield"),
    "cuisine": ("recipeCuisine",),
    "recipecuisine": ("recipeCuisine",),
    "recipecategory": ("recipeCategory", "category"),
    "instructions": ("recipeInstructions", "instructions"),
    "recipeinstructions": ("recipeInstructions", "instructions"),
    "calories": ("nutrition.calories",),
}
CONTENT_FIELDS = ("headline", "title", "name", "article")
DESCRIBING_FIELDS = ("description", "tagline", "summary", "bio", "about", "subtitle")
DOMAIN_LIKE = r"(?i)^[a-z0-9][a-z0-9-]*\.[a-z]{2,}(?:/.*)?$"


def is_site_name(c: Column) -> Column:
    """Too short for a title, or a domain."""
    s = F.trim(c)
    return (F.length(s) < 6) | s.rlike(DOMAIN_LIKE)


def fact_rank(source: Column) -> Column:
    """The place of a source in SOURCES; 99 for what is not a fact of the page itself."""
    at = F.array_position(F.array(*map(F.lit, SOURCES)), source)
    return F.when(at > 0, at.cast("int") - 1).otherwise(99)


def header_facts(headers: Column) -> Column:
    """Response headers that say something of a page, by their names in any case, as facts; blank ones say nothing."""
    found = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda h: F.struct(F.lit("header").alias("source"), F.lit(0).alias("item"), F.concat(F.lit("header."), F.lower(h["key"])).alias("key"), h["value"].alias("value")))
    return F.filter(found, lambda f: f["key"].isin(*[f"header.{h}" for h in HEADERS]) & (f["value"] != ""))


def embed_facts(answer: Column) -> Column:
    """The plain values of an oEmbed answer (JSON text), under their names and under oembed.name; none if it is no JSON object."""
    entries = F.map_entries(F.coalesce(F.from_json(answer, "map<string,string>"), F.create_map().cast("map<string,string>")))
    plain = F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].rlike(r"^\s*[\[{]"))
    rows = lambda prefix: F.transform(plain, lambda e: F.struct(F.lit("oembed").alias("source"), F.lit(0).alias("item"), F.concat(F.lit(prefix), e["key"]).alias("key"), e["value"].alias("value")))
    return F.concat(rows("oembed."), rows(""))


def all_facts(rows: DataFrame) -> Column:
    """The facts of the outline, then those of the columns `headers` (a map) and `oembed` (JSON text), if rows have them."""
    parts = [F.col("page.facts")]
    if "headers" in rows.columns:
        parts.append(header_facts(F.col("headers")))
    if "oembed" in rows.columns:
        parts.append(embed_facts(F.col("oembed")))
    return F.concat(*parts)


def facts(pages: DataFrame) -> DataFrame:
    """(page_id, source, item, rank, ord, key, value) of all pages (page_id, html[, url, headers, oembed]), one parse each.

    A fact for each key that JSON-LD, microdata, microformats, RDFa, OpenGraph, cards, meta elements, response headers and an oEmbed answer
    give; items that lie in items have dotted keys. `ord` counts a page's facts. Null html or a page without facts: no rows.
    """
    rows = outlined(pages.select("page_id", "html", *[c for c in ("url", "headers", "oembed") if c in pages.columns]))
    rows = rows.select("page_id", F.posexplode(all_facts(rows)).alias("ord", "f"))
    return rows.select("page_id", "f.source", "f.item", fact_rank(F.col("f.source")).alias("rank"), "ord", "f.key", "f.value")


def known_facts(found: Column) -> Column:
    """merge() of one page as a map: of the best source the first value of each key; cards, the last."""
    found = F.filter(found, lambda f: f["source"] != "link")  # where an oEmbed answer is, no fact
    order = lambda f, i: F.when(f["source"] == "card", -i).otherwise(i)
    ranked = F.array_sort(F.transform(found, lambda f, i: F.struct(f["key"].alias("key"), fact_rank(f["source"]).alias("rank"), order(f, i).alias("ord"), f["value"].alias("value"))))
    first = F.transform(F.array(ranked), lambda fs: F.filter(fs, lambda f, i: (i == 0) | (f["key"] != F.get(fs, i - 1)["key"])))  # sorted once
    return F.map_from_entries(F.transform(first[0], lambda f: F.struct(f["key"], f["value"])))


def merge(found: DataFrame) -> DataFrame:
    """One value for each page and key: of the best source the first; cards, the last."""
    order = F.when(F.col("source") == "card", -F.col("ord")).otherwise(F.col("ord"))
    return found.groupBy("page_id", "key").agg(F.min_by("value", F.struct("rank", order)).alias("value"))


def as_map(merged: DataFrame) -> DataFrame:
    return merged.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("facts"))


def resolve(facts: Column, field: Field) -> Column:
    """The raw value of a field in a map of facts: its own name first, then its aliases."""
    low = field.name.lower()
    if field.type == "string" and any(x in low for x in DESCRIBING_FIELDS):
        return F.lit(None).cast("string")
    keys = list(dict.fromkeys([field.name, *ALIASES.get(low, ())]))
    content = field.type == "string" and any(x in low for x in CONTENT_FIELDS)
    tries = []
    for k in keys:
        v = F.try_element_at(facts, F.lit(k))
        ok = (v != "") & (v != "[]")
        tries.append(F.when(ok & ~is_site_name(v) if content else ok, v))
    value = F.coalesce(*tries)
    if content and isinstance(field.example, str) and len(field.example) >= 3:
        value = F.when(F.length(value) <= 2 * len(field.example) + 8, value)
    return value


def resolve_all(merged: DataFrame, fields: list[Field]) -> DataFrame:
    """(page_id, data, prefilled: number of fields with a value) from merged facts."""
    rows = as_map(merged)
    data = F.struct(*[coerce(resolve(F.col("facts"), f), f.type).alias(f.name) for f in fields])
    out = rows.select("page_id", data.alias("data"))
    return out.withColumn("prefilled", sum((F.col(f"data.`{f.name}`").isNotNull().cast("int") for f in fields), F.lit(0)))


def skips_rest(prefilled: Column, fields: list[Field], missing: Column, threshold: float = 0.7) -> Column:
    """Enough is known, and what is missing is nothing that a shop must say."""
    critical = r"(?i)\b(price|stock|sku|availability|in_stock|inventory|id|identifier)\b"
    return (prefilled > 0) & (prefilled >= threshold * len(fields)) & ~F.exists(missing, lambda x: x.rlike(critical))


