"""Casts, URLs, classifiers and packing of text against literal values."""

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import coerce, text, urls
from pagelathe.functions.coerce import Field, SchemaInvalid
from pagelathe.operators import outline, relevance
from pagelathe.plans import engine

CASTS = [
    ("35 years old", "integer", 35), ("$1.2M", "float", 1200000.0), ("$1.2M", "integer", 1), ("PT1H30M", "integer", 90), ("P1DT2H", "integer", 1560), ("PT", "integer", 0),
    ("PT30S", "integer", 0), ("PT90S", "integer", 2), ("P1Y", "integer", 1), ("€1.299,00", "float", 1.299), ("10-20", "float", None), ("✓", "boolean", True), ("no", "boolean", False),
    ("✓ Verified", "boolean", None), ("2024-12-20T08:00Z", "date", "2024-12-20"), ("2024-13-45", "date", "2024-13-45"), ("a, b; c | d", "array<string>", ["a", "b", "c", "d"]),
    ("1,N/A", "array<integer>", [1, None]), ("1,x", "array<integer>", None), ("N/A", "float", None), ("—", "string", None), ("AKIA" + "A" * 16, "string", None), ("<b>x</b>  y", "string", "x y"),
]


@pytest.mark.parametrize(("raw", "declared", "want"), CASTS)
def test_cast(spark, raw, declared, want):
    assert spark.range(1).select(coerce.coerce(F.lit(raw), declared)).first()[0] == want


def test_urls(spark):
    u = F.lit("HTTPS://WWW.A.com:443/x/?b=2&utm_source=f&a=1#t")
    row = spark.range(1).select(urls.cache_url(u), urls.crawl_url(u), urls.cache_url(F.lit("http://a.com"))).first()
    assert tuple(row) == ("https://a.com/x?a=1&b=2", "https://www.a.com:443/x?b=2&utm_source=f&a=1", "http://a.com/")


@pytest.mark.parametrize("fields", [[], [Field(" ", "string")], [Field("a", "string"), Field("a", "float")], [Field("a", "money")]])
def test_schema_is_refused(fields):
    with pytest.raises(SchemaInvalid):
        coerce.validate(fields)


def test_tokens(spark):
    assert spark.range(1).select(text.tokens(F.lit("firstName net_worth running stories"))).first()[0] == ["first", "name", "net", "worth", "runn", "stor"]


def test_tokens_are_those_of_each_word(spark):
    texts = ["", " _ ", "__a_", "ΑΣ'Β ΟΔΟΣs_ΣΣ", "İNGs Ias ings things", "𝐀𝐁𝐜s 𝐀𝐁s 𝐀𝐁𝐜ing", "HTMLParser parseHTMLFast aB XMLs", "stations ations xations edlyly", "12s 1234ing", "don't $1 \\ 's ss sss ssss"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.regexp_extract_all("t", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    parts = F.flatten(F.transform(words, lambda w: F.split(F.regexp_replace(w, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"), "_")))
    want = F.transform(F.filter(parts, lambda w: w != ""), lambda w: text.stem(F.lower(w)))
    assert all(r["got"] == r["want"] for r in df.select(text.tokens(F.col("t")).alias("got"), want.alias("want")).collect())


def test_chunks_hold_all_text():
    body = "\n".join(f"line {i} " + "x" * (i % 90) for i in range(400))
    cut = relevance.chunk_text(body)
    assert "".join("".join(cut).split()) == "".join(body.split())
    # the budget counts each line as a quarter of its characters, one at least
    assert all(sum(max(1, len(x) // 4) for x in c.split("\n")) <= relevance.CHUNK_TOKENS for c in cut)


def test_json_ld_fills_fields(spark):
    html = '<html lang="en"><head><meta property="og:title" content="Other"><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Blue chair","offers":[{"price":"12.50"}]}]}</script></head><body><p>hello</p></body></html>' + " " * 600
    page = spark.createDataFrame([(1, "https://a.com/", html + "word " * 200)], "page_id long, url string, html string")
    row = engine.extract(page, [Field("name", "string"), Field("price", "float")]).first()
    assert (row["data"]["name"], row["data"]["price"], row["source"]) == ("Blue chair", 12.5, "metadata")
    assert outline.flatten({"a": [{"b": 1}, {"b": 2, "c": 3}], "d": [1, 2], "e": None}) == {"a.b": 1, "a.c": 3, "d": [1, 2]}


def test_block_page_is_an_error_row(spark):
    page = spark.createDataFrame([(1, "https://a.com/", "<p>Access denied</p>", 200)], "page_id long, url string, html string, status_code int")
    row = engine.extract(page, [Field("name", "string")]).first()
    assert (row["status"], row["error"]["code"], row["error"]["retryable"]) == ("error", "FETCH_BLOCKED", True)
