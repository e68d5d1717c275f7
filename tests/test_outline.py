"""What a page says of itself, syntax by syntax, against literal facts."""

from pagelathe.operators import metadata
from pagelathe.operators.outline import Outline, facts_of, outlined


def said(html, source, base="https://a.com/b/"):
    return [(k, v) for s, _, k, v in facts_of(Outline.of(html), base) if s == source]


def test_microdata_scopes():
    html = """<div itemscope itemtype="https://schema.org/Product"><b itemprop="name alternateName">Chair <i>blue</i></b><img itemprop=image src="x.png">
    <div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop=price content=9.5><b itemprop=name>Offer name</b></div>
    <div itemprop="offers" itemscope><meta itemprop=price content=8><time itemprop=until datetime=2020-01-02>soon</time></div>
    <div itemscope><p itemprop=name>no property of the chair</div></div><p itemprop=name>outside</p>"""
    assert said(html, "microdata") == [
        ("@type", "Product"), ("name", "Chair blue"), ("alternateName", "Chair blue"), ("image", "https://a.com/b/x.png"), ("offers.@type", "Offer"), ("offers.price", "9.5"), ("offers.name", "Offer name"), ("offers.until", "2020-01-02"),
        ("name", "no property of the chair"),
    ]


def test_rdfa_and_microformats():
    html = """<div vocab="http://schema.org/" typeof="schema:Person"><a property="url" href="/jo">x</a><b property="http://schema.org/name">Jo</b><div property=address typeof=PostalAddress><b property=city>Rome</b></div>
    <meta property="og:title" content="not RDFa"></div><b property=name>no scope</b>"""
    assert said(html, "rdfa") == [("@type", "Person"), ("url", "https://a.com/jo"), ("name", "Jo"), ("address.@type", "PostalAddress"), ("address.city", "Rome")]
    html = """<div class="x h-entry"><h1 class=p-name>Title</h1><a class="p-author h-card u-url" href=/kim><img class="u-photo" src=k.png alt=k><b class=p-name>Kim</b></a><time class=dt-published datetime=2020>t</time>
    <i class=p-category>a</i><i class=p-category>b</i><abbr class=p-rating title=5>five</abbr></div><p class="h- p-">no root</p>"""
    assert said(html, "microformat") == [
        ("@type", "h-entry"), ("name", "Title"), ("author.@type", "h-card"), ("author.photo", "https://a.com/b/k.png"), ("author.name", "Kim"), ("url.@type", "h-card"), ("url.photo", "https://a.com/b/k.png"), ("url.name", "Kim"),
        ("published", "2020"), ("category", '["a", "b"]'), ("rating", "5"),
    ]


def test_meta_elements_and_embeds():
    html = """<html lang=en><meta name=Publisher content=P><meta property=author content="only by name"><meta name=generator content=G><meta http-equiv=content-language content=de><meta name=x>
    <link rel="alternate" type="application/json+oembed" href="/o?f=json"><link rel=alternate type="text/xml+oembed" href="/xml"><link rel=next type="application/json+oembed" href="/no"></html>"""
    assert said(html, "meta") == [("html.lang", "en"), ("meta.publisher", "P"), ("header.content-language", "de")]
    assert said(html, "link") == [("oembed", "https://a.com/o?f=json")]


def test_linked_data_that_is_broken():
    html = '<script type="application/ld+json">{"a": </script><script type="application/ld+json">[1, {"a": {"b": [{"c": 1}, {"c": 2, "d": null}]}, "@graph": [{"e": ["x", 2]}, 3]}, null]</script>'
    assert said(html, "json-ld") == [("a.b.c", "1"), ("e", '["x", 2]')]
    assert said('<script type="application/ld+json">{"a": "\\ud800"}</script>', "json-ld") == [("a", "?")]


def test_facts_as_rows(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.com/", "<html lang=en><meta name=author content=A><meta name='twitter:title' content=1><meta name='twitter:title' content=2>", {"LAST-modified": "Mon", "server": "x"}, '{"title": "T", "thumb": {"w": 1}}'), (2, None, None, None, "not json"), (3, "::", "", {}, None)],
        "page_id long, url string, html string, headers map<string,string>, oembed string",
    )
    got = {(r["key"], r["value"]) for r in metadata.merge(metadata.facts(pages)).collect()}
    assert got == {("html.lang", "en"), ("meta.author", "A"), ("twitter:title", "2"), ("header.last-modified", "Mon"), ("oembed.title", "T"), ("title", "T")}
    rows = outlined(pages)
    known = rows.select(metadata.known_facts(metadata.all_facts(rows)).alias("f")).collect()
    assert set(known[0]["f"].items()) == got and known[1]["f"] == {} == known[2]["f"]


def test_outlines_keep_other_columns(spark):
    pages = spark.createDataFrame([(1, "<p>x", "a", None), (2, "<p>y", "b", 3)], "page_id long, html string, page string, begin int")
    got = sorted((r["page_id"], r["begin"], r["page"]["pieces"][0]["text"]) for r in outlined(pages).collect())
    assert got == [(1, None, "x"), (2, 3, "y")]
    assert outlined(pages.limit(0)).collect() == []
    assert outlined(pages.withColumn("s", metadata.F.col("page_id") == 1), skip="s").where("size(page.pieces) = 0").count() == 1
