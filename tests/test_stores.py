"""Robots files, sitemaps, links, and tables that are kept up to date."""

from pyspark.sql import functions as F

from pagelathe.functions import urls
from pagelathe.operators import crawl
from pagelathe.sources import tables
from pagelathe.streaming import fresh


def test_upsert_goes_on_after_gaps_and_reruns(spark, tmp_path):
    target = str(tmp_path / "t")
    write = fresh.upsert(target, ["k"], "at")
    batch = lambda *rows: spark.createDataFrame(rows, "k long, at long, v string")
    assert fresh.latest(spark, target) is None
    write(batch((1, 1, "a"), (2, 1, "b")), 0)
    write(batch((1, 2, "c"), (3, 1, "d")), 1)
    write(batch((1, 2, "c"), (3, 1, "d")), 1)  # the same batch again
    write(batch((2, 0, "old"), (4, 5, "e")), 7)  # after a gap
    assert sorted(tuple(r) for r in fresh.latest(spark, target).collect()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d"), (4, 5, "e")]
    write(batch((4, 6, "f")), 8)
    assert fresh._finished(spark, target) == [1, 7, 8]


def test_stream_drops_repeats_and_counts_hosts(spark, tmp_path):
    rows = [(f"u{i % 3}", f"<p>{i % 2}", "h", 200 if i % 2 else 500) for i in range(12)]
    spark.createDataFrame(rows, "url string, html string, host string, status int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000))).write.parquet(str(tmp_path / "in"))
    pages = spark.readStream.schema("url string, html string, host string, status int, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("once", fresh.once(pages)), ("counts", fresh.host_counts(pages))):
        df.writeStream.format("memory").queryName(name).outputMode("append" if name == "once" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 6
    assert [(r["host"], r["pages"], r["errors"]) for r in spark.table("counts").collect()] == [("h", 12, 6)]


def test_robots_groups(spark):
    body = "User-Agent: *\r\nuser-agent: other\nDisallow : /a # no\n\nUser-agent: x\nDisallow: /b\nUser-agent: *\nAllow: /a/b\nDisallow:\n"
    rules = crawl.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"))
    assert sorted((r["path"], r["allow"]) for r in rules.collect()) == [("/a", False), ("/a/b", True)]


def test_sitemaps(spark):
    xml = '<?xml version="1.0"?><urlset xmlns="x"><url><loc> HTTP://A.com/x/ </loc></url><url><loc>http://a.com/x#y</loc></url><url><loc>http://a.com/z</loc></url></urlset>'
    maps = spark.createDataFrame([("a", xml), ("b", "<urlset><loc>"), ("c", None)], "host string, xml string")
    assert sorted(tuple(r) for r in tables.sitemap_urls(maps).collect()) == [("a", 0, "http://a.com/x"), ("a", 2, "http://a.com/z")]
    assert [r["url"] for r in tables.sitemap_urls(maps, "*/z").collect()] == ["http://a.com/z"]


def test_links_of_any_quotes(spark):
    html = """<a href="/a/">1</a><A class=x HREF='b?c#d'><a href=../e><a href="../../../f"><a name=g><a href="mailto:x"><a href="./h/../i">"""
    got = spark.range(1).select(urls.links(F.lit(html), F.lit("https://x.com/p/q/r"))).first()[0]
    assert got == [f"https://x.com/{p}" for p in ("a", "p/q/b?c", "p/e", "f", "p/q/i")]
