"""Cleaning, identifiers, descriptions, pruning and provider calls against literal values."""

import pytest
from pyspark.sql import functions as F

from pagelathe.functions.coerce import Field
from pagelathe.operators import content, relevance
from pagelathe.operators.outline import outlined
from pagelathe.plans import engine, provider
from pagelathe.plans.provider import CutOff, ProviderError, Request

TITLE = [Field("title", "string")]


def of(spark, html, *make, url=None):
    """Columns made of the outline of one page."""
    rows = outlined(spark.createDataFrame([(url, html)], "url string, html string"))
    got = rows.select(*[m("page").alias(f"c{i}") for i, m in enumerate(make)]).first()
    return got[0] if len(make) == 1 else tuple(got)


def clean(spark, html, url=None, fields=TITLE):
    return of(spark, html, lambda p: content.cleaned(p, content.lit(url) if url else "null", fields))


def identifiers(spark, html, url=None):
    return of(spark, html, lambda p: content.identifiers(p, content.lit(url) if url else "null"))


def test_wiki_article(spark):
    html = """<html><head><title>T</title></head><body><div id=c><p>Paris<sup class="reference">[1]</sup> is a <b>city</b> <span class="IPA nowrap">/x/</span>that has [ iv ] long (ˈpæɹɪs) text to be read by all.
    <h2><span id="See_also">See also</span></h2><ul><li>Other</li></ul><p>more</div><ol class="references"><li>cited</ol><p>References<p>gone</body></html>"""
    assert clean(spark, html) == "Paris is a city that has long text to be read by all."


def test_host_rules_hold_unless_a_field_wants_the_section(spark):
    html = "<body><div class='footnotes x'>the footnote</div><p>opinion of the court</p></body>"
    assert clean(spark, html, "https://www.justia.com/a") == "opinion of the court"
    assert clean(spark, html, "https://www.justia.com/a", [Field("footnotes", "string")]) == "the footnote\nopinion of the court"
    assert clean(spark, html, "https://a.com/") == "the footnote\nopinion of the court"


def test_product_and_list_blocks(spark):
    html = "<body><nav>menu</nav><div class='product big'><h1>Blue chair</h1><table><tr><td>Price<td>12.50</table></div></body>"
    assert clean(spark, html, None, [Field("price", "float")]) == "Blue chair\nPrice\n12.50\n\nBlue chair\nPrice\n12.50"
    quotes = "".join(f"<div class=quote>words of number {i} <i>by</i> one</div>" for i in (1, 2, 2, 3)) + "<li class=x>tiny"
    got = clean(spark, f"<body>{quotes}</body>", None, [Field("quotes", "array<string>")])
    assert got.split("\n\n")[:3] == [f"words of number {i} by one" for i in (1, 2, 3)]
    assert len(of(spark, "".join(f"<article>this is card number {i}</article>" for i in range(200)), lambda p: F.expr(content.list_block(f"{p}.elements", f"{p}.pieces.text"))).split("\n\n")) == 80


def test_identifiers(spark):
    html = """<title> A &amp; B </title><meta name=description content="about it"><meta property="og:description" content="about it"><meta property="og:site_name" content="Site">
    <script type="application/ld+json">{"@graph": [{"name": "Site"}, {"headline": "H", "author": [{"name": "Jo"}]}]}</script><h1>Head <i>line</i></h1><span class="score">123 points</span><b class="votes">none</b><span class=views>7</span>"""
    assert identifiers(spark, html, "https://u@WWW.a.com:8/x").split("\n") == [
        "## Page Identifiers", "URL host: www.a.com", "Title: A & B", "H1: Headline", "Site name: Site", "OG description: about it", "Author: Jo", "Stats: 123 points",
    ]
    assert identifiers(spark, "<p>x") == ""
    for mark in ("<meta name=author content=Kim>", "<meta name='twitter:creator' content='@Kim'>", "<a rel='author x'>Kim</a>", "<p class='by hnuser'>Kim</p>", "<address>Kim</address>"):
        assert of(spark, mark, content.author) == "Kim"


def test_descriptions(spark):
    long = "a paragraph that is long enough to say what the page is about"
    html = f"<meta name=description content='{long.upper()} and more'><main><p>short<p>{long} <sup>9</sup>first</p></main><h1>x</h1><div><p>{long} first</div>"
    assert of(spark, html, content.descriptions) == f"## Candidate descriptions\n- {long.upper()} and more\n- {long} first"
    assert of(spark, "<h1>x</h1><p>short", content.descriptions) == ""


def test_broken_pages(spark):
    broken = ("", "<", "</p></div>", "<div><p><b>text", "<table><tr><td><p>a<td>b", "<script>never ends", "<li>" * 2000 + "x" + "</ul>" * 3, None, "<meta><meta content><a rel><p id class>", '<script type="application/ld+json">{"a": "\\ud800", "author": 5}</script>')
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate(broken)], "page_id long, url string, html string")
    fields = [Field("price", "float"), Field("items", "array<string>"), Field("summary", "string")]
    got = {r["page_id"]: r for r in content.read_pages(pages, fields).collect()}
    assert len(got) == len(broken) and (got[7]["cleaned"], got[7]["identifiers"], got[7]["descriptions"]) == (None, None, None) and got[3]["cleaned"] == "text"
    assert clean(spark, "<body><p>one<p>two<div>three</div>four<br>five</body>") == "one\ntwo\nthree\nfour\nfive"


def test_main_text_without_article(spark):
    """Lines by words and links, those between content included; link lists go, and short lines without a long one beside them."""
    long = "this line has more than sixteen words so that it is content whatever stands before or after it on the page"
    links = "".join(f"<li><a href=/{i}>a link number {i} of the menu</a></li>" for i in range(5))
    html = f"<body><div><ul>{links}</ul></div><div>Log in</div><div><p>{long}</p><p>six words between two long lines</p><p>{long} too</p></div><ul>{links}</ul><div>All rights reserved</div></body>"
    assert clean(spark, html).split("\n") == ["Log in", long, "six words between two long lines", f"{long} too"]
    assert clean(spark, "<body><nav>menu</nav><p>few words</p></body>") == "few words"
    assert clean(spark, f"<body><main>{long}</main><p>{long} outside</p></body>") == long


def test_chunks_at_their_limits():
    assert relevance.pieces("x" * 1600) == ["x" * 1600]
    assert [len(x) for x in relevance.pieces("\n".join(["a" * 800, "b" * 799, "c" * 801]))] == [1600, 801]
    assert [len(x) for x in relevance.pieces("\n".join(["a" * 800, "b" * 801, "c" * 799, "d" * 2000]))] == [800, 1600, 1, 1600, 400]
    assert [len(x) for x in relevance.chunk_text("\n\n".join(["x" * 800] * 5))] == [1601, 1601, 800]


def test_pruned_is_what_the_tables_say(spark, sf_dir):
    fields = [Field("title", "string", "The thing", "what it is"), Field("author", "string")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in relevance.relevant(docs, fields, budget=300).collect()}
    query = relevance.query_terms(fields)
    assert query == relevance.query_tokens(spark, fields)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {i: relevance.pruned(t, query, 300) for i, t in texts.items()} and any(got[i] != t for i, t in texts.items())


def test_texts_are_pruned_in_their_rows(spark):
    fields = [Field("title", "string", "The thing", "what it is")]
    query = relevance.query_terms(fields)
    texts = ["\n\n".join(f"{w} {k} says {'the title of a thing' if k % 3 == s else 'something else'} " * 30 for k in range(12)) for s, w in enumerate(("Alpha", "Beta", "Gamma"))]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (2, None), (3, ""), (4, "x - y " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = relevance.relevant(docs, fields, budget=800)
    want = [(i, relevance.pruned(t or "", query, 800) if t else t) for i, t in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert all(w[1] != t for w, (_, t) in zip(want[:3], rows[:3], strict=True))
    # nothing is exchanged
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


class Answers:
    def __init__(self, *answers):
        self.answers, self.budgets = list(answers), []

    def extract(self, request):
        self.budgets.append(request.output_tokens)
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


@pytest.mark.parametrize(
    ("answers", "want", "calls", "waited"),
    [
        (['{"a": 1}'], {"a": 1}, 1, []), (['So: ```json\n{"a": {"b": "}"}}\n```'], {"a": {"b": "}"}}, 1, []), ([RuntimeError("503 overloaded")] * 3 + ["{}"], {}, 4, [0.5, 1.0, 2.0]),
        ([RuntimeError("503")] * 4, "LLM_UNAVAILABLE", 4, [0.5, 1.0, 2.0]), ([RuntimeError("quota; retry-after: 3")] * 3, "LLM_RATE_LIMITED", 3, [3.0, 3.0]), ([RuntimeError("invalid argument")], "LLM_BAD_REQUEST", 1, []),
        (["", "{}"], {}, 2, [0.5]), (["[1]", "[1]"], "LLM_ERROR", 2, [1.0]), (['{"a": ', '{"a": 1', '{"a": 2}'], {"a": 2}, 3, []), (['{"a": '] * 3, "LLM_ERROR", 3, []), ([TimeoutError("deadline"), "{}"], {}, 2, [0.5]),
    ],
)
def test_calls(answers, want, calls, waited):
    p, slept = Answers(*answers), []
    request = Request("t", "p", tuple(TITLE), 1000)
    if isinstance(want, str):
        with pytest.raises(ProviderError) as e:
            provider.call(p, request, slept.append, lambda: 0.0)
        assert e.value.code == want
    else:
        assert provider.call(p, request, slept.append, lambda: 0.0) == want
    assert (len(p.budgets), slept) == (calls, waited)
    if isinstance(answers[0], str) and answers[0] == '{"a": ':
        assert p.budgets == [1000, 1500, 2000]


def test_calls_end_at_the_deadline():
    now = iter(range(0, 1000, 20))
    with pytest.raises(ProviderError):
        provider.call(Answers(*[RuntimeError("503")] * 9), Request("t", "p", (), 1), lambda s: None, lambda: next(now))
    assert isinstance(provider.classified(CutOff()), CutOff)


def test_budgets():
    f = lambda n, t: Field(n, t)
    assert provider.output_budget([f("a", "string")]) == 4096 and provider.output_budget([f(f"a{i}", "array<string>") for i in range(9)]) == 4736
    assert provider.output_budget([f(f"a{i}", "array<string>") for i in range(90)]) == 8192
    assert provider.is_simple([f("age", "integer")]) and not provider.is_simple([f("Bio_text", "string")]) and not provider.is_simple([f("d", "date")])
    assert [provider.thinking_budget(x) for x in ([f("a", "string")], [f("d", "date")], [f("d", "array<string>")])] == [0, 512, 1024]
    assert (provider.model_for("x" * 1_999_999), provider.model_for("x" * 2_000_000)) == ("primary", "fallback")


def test_extract_asks_again_and_keeps_rows_apart(spark):
    class Second:
        """Knows the price only when asked with more text."""

        def extract(self, request):
            assert "<page_content>" in request.prompt
            return {"title": "T", "price": "12.5" if request.model == "fallback" else None, "author": "x"}

    body = "<html><body><p>" + "some words 1 of the page " * 60 + "</p></body></html>"
    known = body.replace("<body>", '<head><script type="application/ld+json">{"@type":"Product","name":"Blue chair","offers":{"price":"9.50"}, "author": "Jo"}</script></head><body>')
    pages = spark.createDataFrame([(1, "https://a.com/", body), (1, "https://b.com/", known), (2, "https://c.com/", None), (1, "https://a.com/", body)], "page_id long, url string, html string")
    fields = [Field("name", "string"), Field("price", "float"), Field("author", "string")]
    got = sorted((r["url"], r["source"], r["data"]["price"], r["data"]["author"]) for r in engine.extract(pages, fields, Second()).collect())
    assert got == [("https://a.com/", "fallback", 12.5, "x")] * 2 + [("https://b.com/", "metadata", 9.5, "Jo"), ("https://c.com/", "fallback", 12.5, "x")]


def test_failed_calls_are_error_rows(spark):
    class Down:
        def extract(self, request):
            raise RuntimeError("400 invalid argument")

    pages = spark.createDataFrame([(1, "https://a.com/", "<p>" + "word 1 " * 200)], "page_id long, url string, html string")
    row = engine.extract(pages, TITLE, Down()).first()
    assert (row["status"], row["error"]["code"], row["data"]) == ("error", "LLM_BAD_REQUEST", None)
