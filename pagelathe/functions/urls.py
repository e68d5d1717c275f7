"""URLs as Columns: the crawl form, the cache key, hosts, freshness classes."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "yclid")
TRACKERS = (
    "doubleclick.net", "google-analytics.com", "googletagmanager.com", "facebook.com", "fb.com", "twitter.com", "analytics.twitter.com",
    "scorecardresearch.com", "quantserve.com", "adnxs.com", "rubiconproject.com", "pubmatic.com", "amazon-adsystem.com",
)
PRODUCT_PATHS = ("/product/", "/products/", "/dp/", "/item/", "/p/")
NEWS_PATHS = ("/news/", "/blog/", "/article/", "/articles/", "/posts/", "/post/")
REFERENCE_PATHS = ("/docs/", "/doc/", "/reference/", "/wiki/", "/manual/")
STABLE_HOSTS = ("wikipedia.org", "readthedocs.io", "docs.python.org")
PRODUCT_TYPES, NEWS_TYPES = ("Product", "Offer", "AggregateOffer"), ("NewsArticle", "BlogPosting", "Article", "Report")
VOLATILE = r"(?i)price|stock|availability|inventory|in_stock|quantity"
SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query of an absolute URL."""
    return F.regexp_extract(url, SPLIT, i)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def crawl_url(url: Column) -> Column:
    """Scheme and authority in lower case, no slash at the end of the path, no fragment."""
    path = F.regexp_replace(part(url, 3), r"/+$", "")
    query = part(url, 4)
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def cache_url(url: Column) -> Column:
    """The cache key: no www, default port, user, tracking parameters or fragment; parameters sorted."""
    scheme = F.lower(part(url, 1))
    port = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    default = F.when(scheme == "http", "80").when(scheme == "https", "443").otherwise("")
    name = F.regexp_replace(host(url), r"^www\.", "")
    path = part(url, 3)
    path = F.when(path == "", "/").otherwise(F.when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(path))
    pairs = F.filter(F.split(part(url, 4), "&"), lambda x: (x != "") & ~F.lower(F.regexp_extract(x, r"^([^=]*)", 1)).isin(*TRACKING))
    pairs = F.array_sort(F.transform(pairs, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("=")))))
    query = F.array_join(pairs, "&")
    return F.concat(scheme, F.lit("://"), name, F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def walked(path: Column) -> Column:
    """A path without . and .. segments: a step up takes the segment before it away, at the root nothing."""
    path_only, rest = F.regexp_extract(path, r"^[^?#]*", 0), F.regexp_extract(path, r"[?#].*$", 0)
    steps = F.slice(F.split(path_only, "/"), 2, F.length(path) + 1)
    none = F.array().cast("array<string>")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(steps, none, lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    ends = F.when(path_only.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), ends, rest)


def resolve(base: Column, href: Column) -> Column:
    """href as seen from base: absolute, scheme-relative, root-relative, query or relative to the folder."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), r"[^/]*$", "")
    near = F.concat(F.when(folder == "", "/").otherwise(folder), href)
    near = walked(near)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, part(base, 3), href))
        .otherwise(F.concat(root, F.when(href.rlike(r"(^|/)\.{1,2}([/?#]|$)"), near).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), href))))
    )


def links(html: Column, base: Column) -> Column:
    """Distinct http links of a page in crawl form, in document order; href with any quotes or none."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), F.lit(1))
    found = F.transform(tags, lambda h: crawl_url(resolve(base, F.trim(F.regexp_replace(h, "^[\"']|[\"']$", "")))))
    return F.array_distinct(F.filter(found, lambda u: u.rlike("^https?://")))


def on_domain(name: Column, domains: tuple[str, ...]) -> Column:
    """The host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | name.endswith("." + d)
    return out


def is_tracker(url: Column) -> Column:
    return on_domain(host(url), TRACKERS)


def follows(url: Column, glob: str) -> Column:
    """url matches a shell pattern whole; * goes over slashes."""
    if len(glob) > 256 or glob.count("*") > 8:
        raise ValueError("a pattern has at most 256 characters and 8 stars")
    inner = fnmatch.translate(glob).removeprefix("(?s:").replace(r")\z", "").replace(r")\Z", "")
    return url.rlike(f"(?s)^(?:{inner})$")


def ttl_seconds(url: Column, volatile: Column, kind: Column | None = None) -> Column:
    """Seconds that a result stays fresh: product pages, news, stable hosts, reference pages, the rest."""
    name, path = host(url), F.lower(part(url, 3))
    has = lambda marks: path.rlike("|".join(marks))
    of = lambda kinds: kind.isin(*kinds) if kind is not None else F.lit(False)
    stable = F.lit(False)
    for h in STABLE_HOSTS:
        stable = stable | name.endswith(h)
    return (
        F.when(of(PRODUCT_TYPES) | has(PRODUCT_PATHS), 86400)
        .when(of(NEWS_TYPES) | has(NEWS_PATHS), 21600)
        .when(~volatile & stable, 7776000)
        .when(~volatile & (name.endswith(".wiki") | has(REFERENCE_PATHS)), 2592000)
        .otherwise(86400)
    )


def field_ttl(field: Column, page_ttl: Column, halve: Column, volatile_ttl: int = 600) -> Column:
    ttl = F.when(field.rlike(VOLATILE), F.least(page_ttl, F.lit(volatile_ttl))).otherwise(page_ttl)
    return F.when(halve, F.floor(ttl / 2)).otherwise(ttl).cast("int")


def amp_url(url: Column) -> Column:
    """Where an AMP copy may be."""
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), F.regexp_replace(part(url, 3), r"/+$", ""), F.lit("/amp"))


#: Hosts and address ranges that are not to be fetched (fixed patterns): names of this machine, and IPv4 and IPv6 addresses that are not public.
PRIVATE_NAMES = ("localhost", "metadata.google.internal")
PRIVATE_IPV4 = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^192\.0\.0\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^198\.1[89]\.|^(22[4-9]|23\d|24\d|25[0-5])\."
PRIVATE_IPV6 = r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|::ffff:.*)\]$"


def url_safety(url: Column) -> Column:
    """bad: no http URL with a host; private: its host is this machine or an address that is not public; else ok. Names are not looked up."""
    authority = F.lower(F.regexp_replace(part(url, 2), r"^.*@", ""))
    name = F.when(authority.startswith("["), F.regexp_extract(authority, r"^(\[[^\]]*\])", 1)).otherwise(F.regexp_replace(authority, r":\d*$", ""))
    ipv4 = name.rlike(r"^\d+\.\d+\.\d+\.\d+$") & name.rlike(PRIVATE_IPV4)
    odd = name.rlike(r"^(0x[0-9a-f]+|\d+)$")  # an address written as one number
    private = name.isin(*PRIVATE_NAMES) | name.endswith(".localhost") | ipv4 | odd | name.rlike(PRIVATE_IPV6)
    return F.when(~F.lower(part(url, 1)).isin("http", "https") | (name == ""), "bad").when(private, "private").otherwise("ok")


def accept_language(locale: Column) -> Column:
    """The Accept-Language header of a locale like de-AT: itself, its language, then English."""
    base = F.regexp_extract(locale, r"^([A-Za-z]{2,3})", 1)
    wider = F.when(base != locale, F.concat(F.lit(","), base, F.lit(";q=0.9"))).otherwise("")
    return F.when(locale.isNull() | (base == ""), "en-US,en;q=0.9").when(base == "en", F.concat(locale, wider)).otherwise(F.concat(locale, wider, F.lit(",en;q=0.8")))
