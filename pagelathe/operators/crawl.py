"""Breadth-first crawls over tables of links, and pacing of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.functions.urls import follows


def frontier(links: DataFrame, seen: DataFrame, glob: str | None, room: int | None) -> DataFrame:
    """The next level: (url, ord) of links (src_ord, ord, dst) that are new, match, and fit; the first place counts.

    ord is the path of link numbers from the seed, which sorts pages as a queue would."""
    rows = links.where(follows(F.col("dst"), glob)) if glob else links
    rows = rows.join(seen.select(F.col("url").alias("seen")), F.col("dst") == F.col("seen"), "left_anti")
    rows = rows.groupBy("dst").agg(F.min(F.struct("src_ord", "ord")).alias("at"))
    if room is not None:
        rows = rows.orderBy("at").limit(room)
    return rows.select(F.col("dst").alias("url"), F.concat("at.src_ord", F.array("at.ord")).alias("ord"))


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int | None = None, glob: str | None = None) -> DataFrame:
    """(url, depth) of all pages that are reached from seeds (url) over edges (src, dst, ord), level by level.

    Each level is an anti join of the links of the last one with what is visited; it is checkpointed, so that lineage
    does not grow with the depth. The page limit takes pages in order of their first link.
    """
    level = seeds.select("url").distinct().select("url", F.array(F.xxhash64("url")).alias("ord")).withColumn("depth", F.lit(0))
    seen = level = level.checkpoint() if _has_folder(edges) else level.persist()
    for depth in range(1, max_depth + 1):
        room = None if max_pages is None else max_pages - seen.count()
        if room is not None and room <= 0:
            break
        out = edges.join(level.select("url", F.col("ord").alias("src_ord")), F.col("src") == F.col("url")).select("src_ord", edges["ord"].cast("long").alias("ord"), "dst")
        level = frontier(out, seen, glob, room).withColumn("depth", F.lit(depth))
        level = level.checkpoint() if _has_folder(edges) else level.persist()
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.select("url", "depth")


def _has_folder(df: DataFrame) -> bool:
    return df.sparkSession.sparkContext.getCheckpointDir() is not None


def error_streak(status: Column, host: str, ts: str, tie: str) -> Column:
    """429 and 503 answers of a host in a row so far, this one included; success and redirects start anew."""
    w = Window.partitionBy(host).orderBy(ts, tie)
    island = F.sum(F.when(status.between(200, 399), 1).otherwise(0)).over(w)
    run = Window.partitionBy(host, F.col("__island")).orderBy(ts, tie)
    return island, F.sum(F.when(status.isin(429, 503), 1).otherwise(0)).over(run)


def pacing(visits: DataFrame, host: str = "host", ts: str = "ts", tie: str = "id", low_ms: int = 250, high_ms: int = 750) -> DataFrame:
    """visits (host, ts, id, status) with elapsed_ms, streak_before, the gap's bounds, and whether it is too short."""
    island, streak = error_streak(F.col("status"), host, ts, tie)
    rows = visits.withColumn("__island", island).withColumn("streak", streak)
    w = Window.partitionBy(host).orderBy(ts, tie)
    rows = rows.withColumn("elapsed_ms", F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1000))
    rows = rows.withColumn("streak_before", F.coalesce(F.lag("streak").over(w), F.lit(0)))
    twice = F.when(F.col("streak_before") >= 2, 2).otherwise(1)
    rows = rows.withColumn("min_gap_ms", twice * low_ms).withColumn("max_gap_ms", twice * high_ms)
    return rows.withColumn("violates", F.coalesce(F.col("elapsed_ms") < F.col("min_gap_ms"), F.lit(False))).drop("__island")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, path, allow) from robots (host, body): the rules of the groups that name the agent in any case, else of those for *.

    A group is some User-agent lines in a row and the rules up to the next User-agent line after a rule. A group names the agent if its
    word is the agent's product name (what stands before a slash). A host whose groups name the agent without rules has none for it.
    """
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    kind = F.regexp_extract(F.lower("line"), r"^(user-agent|allow|disallow)\s*:", 1)
    lines = lines.withColumn("kind", kind).where("kind != ''").withColumn("value", F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)))
    w = Window.partitionBy("host").orderBy("n")
    opens = (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "user-agent")
    rows = lines.withColumn("opens", opens).withColumn("group", F.sum(F.col("opens").cast("int")).over(w))
    name = agent.split("/")[0].strip().lower()
    says = F.lower(F.trim(F.split_part("value", F.lit("/"), F.lit(1))))
    named = rows.where(F.col("kind") == "user-agent").groupBy(F.col("host").alias("h"), F.col("group").alias("g")).agg(F.bool_or(says == name).alias("mine"), F.bool_or(F.col("value") == "*").alias("all"))
    named = named.withColumn("host_mine", F.bool_or("mine").over(Window.partitionBy("h"))).where(F.when(F.col("host_mine"), F.col("mine")).otherwise(F.col("all")))
    rules = rows.where("kind != 'user-agent' and value != ''")
    return rules.join(named, (F.col("host") == F.col("h")) & (F.col("group") == F.col("g")), "left_semi").select("host", F.col("value").alias("path"), (F.col("kind") == "allow").alias("allow"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, host, path) with `allowed`: by the longest rule that fits, of equals an allowing one; without rules, yes.

    A rule is filed under what it says before its first * or $. A path looks its own beginnings up, of those lengths that rules have: an equi-join on
    host and beginning, so a host with many rules and many pages compares no page with all rules. A * stands for any characters, a $ at the end for the end.
    """
    stem = F.regexp_extract("path", r"^[^*$]*", 0)
    filed = rules.select(F.col("host").alias("h"), F.col("path").alias("rule"), "allow", stem.alias("stem")).distinct()
    lengths = filed.groupBy("h").agg(F.collect_set(F.length("stem")).alias("lengths"))
    looked = urls.distinct().join(lengths, F.col("host") == F.col("h"), "left").drop("h")
    tries = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: n <= F.length("path"))
    looked = looked.withColumn("__n", F.explode_outer(tries)).withColumn("__stem", F.substring(F.col("path"), F.lit(1), F.col("__n")))
    hits = looked.join(filed, (F.col("host") == F.col("h")) & (F.col("__stem") == F.col("stem")), "left")
    # the rule as a pattern: its characters literally, but for * and a last $
    literal = F.regexp_replace(F.regexp_replace("rule", r"\$$", ""), r"([\\\.\^\$\|\?\+\(\)\[\]\{\}])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(literal, r"\*", ".*"), F.when(F.col("rule").endswith("$"), "$").otherwise(""))
    plain = F.col("rule") == F.col("stem")
    fits = F.when(F.col("rule").isNull(), False).when(plain, True).otherwise(F.call_function("rlike", F.col("path"), pattern))
    best = hits.groupBy("url", "host", "path").agg(F.max_by(F.when(fits, F.col("allow")), F.when(fits, F.struct(F.length("rule"), F.col("allow")))).alias("allow"))
    return best.select("url", "host", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))


def release_times(requests: DataFrame, low_ms: int = 250, high_ms: int = 750, buckets: int = 64) -> DataFrame:
    """requests (host, id, ts, streak) with `gap_ms` and `release`, when each may be sent: not before ts, and its gap after the host's one before.

    A gap is drawn between low_ms and high_ms by a hash of the id, doubled from a streak of two refusals on. The recurrence release = max(ts,
    release before + gap) is, with G the running sum of gaps, G + the running maximum of ts - G. Both are running aggregates of time slices first and of
    rows within a slice then, so a hot host is dealt over `buckets` slices of its time and no task sees it whole. Ties of ts come by id.
    """
    gap = (F.lit(low_ms) + F.pmod(F.xxhash64("id"), F.lit(max(1, high_ms - low_ms)))) * F.when(F.coalesce(F.col("streak"), F.lit(0)) >= 2, 2).otherwise(1)
    rows = requests.withColumns({"gap_ms": gap, "__ms": F.unix_millis(F.col("ts").cast("timestamp"))})
    span = rows.groupBy("host").agg(F.min("__ms").alias("__from"), F.max("__ms").alias("__to"))
    rows = rows.join(span, "host").withColumn("__slice", F.floor((F.col("__ms") - F.col("__from")) * F.lit(buckets) / (F.col("__to") - F.col("__from") + 1)).cast("int"))
    inner = Window.partitionBy("host", "__slice").orderBy("ts", "id")
    rows = rows.withColumn("__sum", F.sum("gap_ms").over(inner))
    rows = rows.withColumn("__most", F.max(F.col("__ms") - F.col("__sum")).over(inner))
    slices = rows.groupBy("host", "__slice").agg(F.sum("gap_ms").alias("g"), F.max(F.col("__ms") - F.col("__sum")).alias("m"))
    before = Window.partitionBy("host").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__before", F.coalesce(F.sum("g").over(before), F.lit(0)))
    slices = slices.withColumn("__reached", F.max(F.col("m") - F.col("__before")).over(before)).select("host", "__slice", "__before", "__reached")
    rows = rows.join(slices, ["host", "__slice"])
    total = F.col("__before") + F.col("__sum")
    reached = F.greatest(F.col("__most") - F.col("__before"), F.col("__reached"))
    return rows.select(*requests.columns, "gap_ms", F.timestamp_millis((total + reached).cast("long")).alias("release"))
