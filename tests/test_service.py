"""Batches in order, crawls with counters, the caches' round trip, sources beside the pages, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from pagelathe.__main__ import main
from pagelathe.functions import urls
from pagelathe.functions.coerce import Field
from pagelathe.operators import cache
from pagelathe.plans import chain, service
from pagelathe.sources import tables

def now():
    return F.expr("timestamp '2024-01-01 00:00:00'")


FIELDS = [Field("title", "string"), Field("rank", "integer")]


def page(i):
    return (i, f"https://a.com/{i}", f"<html><body><article><p>Title of page {i}</p><p>rank: {i}</p><p>{'text 1 of it ' * 60}</p></article></body></html>")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([page(i) for i in range(6)], "page_id long, url string, html string").cache()


def test_batch_keeps_order_and_repeats(spark, pages):
    asked = ["https://a.com/3", "https://a.com/9", "http://10.0.0.1/", "https://A.com/3/#x", "https://a.com/1", "https://a.com/5"]
    requests = spark.createDataFrame(list(enumerate(asked)), "ordinal long, url string")
    old = spark.createDataFrame([("https://a.com/5", '{"title": "kept", "rank": 55}', "2024-01-02 00:00:00"), ("https://a.com/1", "{}", "2023-01-01 00:00:00")], "url_key string, payload string, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    got = service.batch(requests, pages, FIELDS, cached=old, now=now()).orderBy("ordinal").collect()
    assert [(r["status"], r["source"], r["data"] and r["data"]["rank"], r["error"] and r["error"]["code"]) for r in got] == [
        ("success", "provider", 3, None), ("error", None, None, "URL_UNREACHABLE"), ("error", None, None, "URL_UNREACHABLE"), ("success", "provider", 3, None), ("success", "provider", 1, None), ("success", "cache", 55, None),
    ]
    with pytest.raises(service.BatchFailed, match="request 1"):
        service.batch(requests, pages, FIELDS, fail_fast=True)


def test_crawl(spark, pages):
    edges = spark.createDataFrame([(f"https://a.com/{a}", f"https://a.com/{b}", i) for i, (a, b) in enumerate([(0, 1), (0, 2), (1, 3), (3, 4), (2, 9), (0, 5)])], "src string, dst string, ord long")
    seeds = spark.createDataFrame([("https://a.com/0",)], "url string")
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /5")], "host string, body string")
    rows, counters = service.crawl_pages(pages, edges, seeds, FIELDS, max_depth=2, robots=robots)
    assert {r["url"][-1]: (r["depth"], r["status"]) for r in rows.collect()} == {"0": (0, "success"), "1": (1, "success"), "2": (1, "success"), "3": (2, "success"), "9": (2, "error")}
    assert tuple(counters.first()) == (4, 1, 1)


def test_one_page_and_deadline(spark):
    row = service.extract_one(spark, *page(7)[1:], FIELDS)
    assert (row["status"], row["data"]["rank"]) == ("success", 7)
    assert service.within(30, spark, lambda: 5) == 5

    def slow():
        return spark.range(4).select(F.udf(lambda i: __import__("time").sleep(20) or i, "long")("id")).collect()

    assert service.within(1.5, spark, slow) is None


def test_caches(spark):
    rows = spark.createDataFrame([("https://a.com/x?utm_source=f", "success", ("T", 5)), ("https://a.com/y", "success", ("T", None)), ("https://a.com/z", "error", None)], "url string, status string, data struct<title:string,rank:bigint>")
    kept = cache.result_rows(rows, FIELDS, now()).collect()
    assert [(r["url_key"], json.loads(r["payload"]), str(r["expires_at"])) for r in kept] == [("https://a.com/x", {"title": "T", "rank": 5}, "2024-01-02 00:00:00")]
    fields = cache.field_rows(rows.where("status = 'success'"), FIELDS, F.lit(1000), now(), halve=F.col("data.rank").isNull())
    assert sorted((r["url_key"][-1], r["field"], r["value"], str(r["expires_at"])[11:]) for r in fields.collect()) == [("x", "rank", "5", "00:16:40"), ("x", "title", "T", "00:16:40"), ("y", "title", "T", "00:08:20")]
    requests = spark.createDataFrame([("https://a.com/x",), ("https://a.com/q",)], "url_key string")
    found = {r["url_key"][-1]: r["known"] for r in cache.field_lookup(requests, fields, FIELDS, now()).collect()}
    assert found == {"x": {"title": "T", "rank": "5"}, "q": {}}
    assert cache.text_rows(spark.createDataFrame([("h", "x" * 10), ("g", "x" * 300_000)], "hash string, text string"), now()).count() == 1


def test_url_safety(spark):
    private = "http://127.0.0.1/ http://a@10.1.1.1:80/ https://192.168.0.1 http://172.16.0.1/ http://169.254.169.254/x http://100.64.0.1/ http://[::1]/ http://[fe80::1]/ http://localhost:8/ http://2130706433/ http://0x7f000001/ http://x.localhost/".split()
    ok = "http://a.com/ https://8.8.8.8/ http://172.32.0.1/ http://[2001:db8::1]/ http://11.com/".split()
    bad = "ftp://a.com/ file:///etc/passwd x http:///p".split()
    df = spark.createDataFrame([(u, k) for us, k in ((private, "private"), (ok, "ok"), (bad, "bad")) for u in us], "u string, want string")
    assert df.where(urls.url_safety(F.col("u")) != F.col("want")).collect() == []
    langs = spark.range(1).select(*[urls.accept_language(F.lit(x).cast("string")) for x in ("de-AT", "en-GB", "fr", None)]).first()
    assert tuple(langs) == ("de-AT,de;q=0.9,en;q=0.8", "en-GB,en;q=0.9", "fr,en;q=0.8", "en-US,en;q=0.9")


def test_sources_beside_pages(spark):
    files = spark.createDataFrame([("a", bytearray("é".encode()), None), ("b", bytearray(b"\xe9"), "latin-1"), ("c", bytearray(b"\xe9x"), "nonsense"), ("d", None, None)], "url string, content binary, charset string")
    assert [r["html"] for r in tables.decoded(files).orderBy("url").collect()] == ["é", "é", "\ufffdx", None]
    two = spark.createDataFrame([("a", "plain", "js_framework"), ("b", "plain", "none"), ("c", "plain", "empty_body")], "url string, html string, reason string")
    shots = spark.createDataFrame([("a", "shot"), ("b", "shot")], "url string, html string")
    assert sorted((r["url"], r["html"], r["render_mode"]) for r in tables.rendered(two, shots).collect()) == [("a", "shot", "browser"), ("b", "plain", "plain"), ("c", "plain", "plain")]
    found = tables.embedded(spark.createDataFrame([(1, "e"), (2, None)], "page_id long, oembed string"), spark.createDataFrame([("e", '{"title": "T"}')], "endpoint string, json string"))
    assert sorted((r["page_id"], r["key"], r["value"]) for r in found.collect()) == [(1, "oembed.title", "T"), (1, "title", "T")]
    images = tables.image_bytes(spark.createDataFrame([("i",), ("j",)], "image string"), spark.createDataFrame([("i", "image/tiff", bytearray(b"x"))], "url string, mime string, bytes binary"))
    assert [(r["image"], r["mime"]) for r in images.collect()] == [("i", "image/jpeg")]
    archive = spark.createDataFrame([("a", "reader", "r" * 900, 200), ("a", "wayback", "w" * 900, 200), ("a", "cache", "short", 200)], "url string, source string, html string, status_code int")
    assert tables.archived(spark.createDataFrame([("a", None)], "url string, html string"), archive).first()["html"][0] == "w"


def test_command_line(spark, pages, tmp_path, capsys):
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "urls").write_text("# seeds\nhttps://a.com/2\n\nhttps://a.com/8\n")
    schema = json.dumps([{"field": "title", "type": "string"}, {"field": "rank", "type": "integer"}])
    assert main(["batch", "--pages", str(tmp_path / "pages"), "--schema", schema, "--urls", str(tmp_path / "urls")]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [(r["status"], r["data"] and r["data"]["rank"]) for r in rows] == [("success", 2), ("error", None)]


def test_pages_are_asked_once_with_fail_fast(spark, pages, tmp_path):
    class Counted:
        def extract(self, request):
            with open(f"{folder}/asked", "a") as f:
                f.write("x")
            return {"title": "T", "rank": "1"}

    folder = str(tmp_path)
    requests = spark.createDataFrame([(i, f"https://a.com/{i}") for i in range(4)], "ordinal long, url string")
    for run in (lambda: service.batch(requests, pages, FIELDS, Counted(), fail_fast=True), lambda: service.extract_from(requests, chain.Sources(pages), FIELDS, Counted(), fail_fast=True)):
        rows = run()
        assert rows.count() == 4 == len(rows.collect())
    assert len(open(f"{folder}/asked").read()) == 8


def test_the_first_good_source_supplies_a_page(spark, pages):
    shut = "<html><title>Just a moment...</title><body>cf-turnstile</body></html>"
    long = page(1)[2]
    given = spark.createDataFrame([(1, "https://a.com/1", long, 200), (2, "https://a.com/1", shut, 403), (3, "https://a.com/2", shut, 403), (4, "https://a.com/3", None, None), (5, "https://b.com/", long, 200)], "page_id long, url string, html string, status_code int")
    archive = spark.createDataFrame([("https://a.com/2", "reader", long, 200), ("https://a.com/2#x", "wayback", long + "w", 200), ("https://a.com/3", "amp", "short", 200)], "url string, source string, html string, status_code int")
    marks = spark.createDataFrame([("b.com", "2023-12-31 23:55:00"), ("a.com", "2023-12-31 22:00:00")], "host string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = ["https://a.com/1", "https://a.com/2", "https://a.com/3", "https://a.com/9", "https://b.com/", None, "http://127.0.0.1/", "https://A.com/1#f"]
    requests = spark.createDataFrame(list(enumerate(asked)), "ordinal long, url string")
    rows = chain.gathered(requests, chain.Sources(given, None, archive, marks), now())
    got = {r["ordinal"]: (r["via"], r["code"], (r["html"] or "")[-1:]) for r in rows.collect()}
    assert got == {
        0: (None, "FETCH_BLOCKED", ""), 1: ("archive", None, "w"), 2: (None, "URL_UNREACHABLE", ""), 3: (None, "URL_UNREACHABLE", ""), 4: (None, "FETCH_BLOCKED", ""), 5: (None, "URL_UNREACHABLE", ""), 6: (None, "URL_UNREACHABLE", ""),
        7: (None, "FETCH_BLOCKED", ""),
    }
    with_shots = chain.gathered(requests, chain.Sources(given, spark.createDataFrame([("https://a.com/1", long)], "url string, html string"), archive), now())
    assert {r["ordinal"]: r["via"] for r in with_shots.collect()} == {0: "browser", 1: "archive", 2: None, 3: None, 4: "plain", 5: None, 6: None, 7: "browser"}
    after = chain.marks_after(rows, marks, now())
    assert {(r["host"], str(r["ts"])[:10]) for r in after.collect()} == {("b.com", "2024-01-01")}


def test_caches_and_counters_of_a_chain(spark, pages):
    from pyspark.sql import Row

    text = spark.createDataFrame([Row(html=page(2)[2])]).select(F.sha2("html", 256).alias("hash"), F.lit("Cached title\nrank: 77\n" + "more text " * 40).alias("text"), (now() + F.expr("interval 1 hour")).alias("expires_at"))
    known = spark.createDataFrame([("https://a.com/3", "title", "string", "Known"), ("https://a.com/3", "rank", "integer", "33")], "url_key string, field string, type string, value string").withColumn("expires_at", now() + F.expr("interval 1 hour"))
    requests = spark.createDataFrame([(i, f"https://a.com/{i}") for i in (1, 2, 3, 77)], "ordinal long, url string")
    rows, seen = service.observed(service.extract_from(requests, chain.Sources(pages, texts=text, fields=known), FIELDS, now=now()))
    got = {r["ordinal"]: r["data"] and (r["data"]["title"], r["data"]["rank"]) for r in rows.collect()}
    assert got == {1: ("Title of page 1", 1), 2: ("Cached title", 77), 3: ("Known", 33), 77: None}
    assert seen.get["rows"] == 4 and seen.get["failed"] == 1 and seen.get["metadata"] == 1 and seen.get["provider"] == 2
