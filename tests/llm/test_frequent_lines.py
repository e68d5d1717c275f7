"""Lines that recur on a host: counted by distinct documents, and taken out of the texts that stay."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelathe.llm import linefreq, shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LIMITS = linefreq.Limits(min_words=1)


def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_inner_lines_of_a_block_count_in_all_documents(spark):
    head, foot = "alpha one two\nbeta one two\ngamma one two", "xi one two\nupsilon one two\nzeta one two"
    rows = [(i, f"{head}\nown {word(i)} is here\n{foot}", "en", "h", 0) for i in range(200)]
    got = linefreq.quality(spark.createDataFrame(rows, DOCS), LIMITS).collect()
    assert {(r["n_words"], r["left_words"], r["kept"]) for r in got} == {(22, 4, False)}


def test_copies_of_a_page_do_not_hide_a_frequent_line(spark):
    menu = "the menu line of this host"
    rows = [(i, f"one page copied often\n{menu}\nend of page", "en", "h", 0) for i in range(600)]
    rows += [(1000 + i, f"page {word(i)}\n{menu}\nlast {word(i + 7)}", "en", "h", 0) for i in range(400)]
    got = {r["doc_id"]: r["n_words"] - r["left_words"] for r in linefreq.quality(spark.createDataFrame(rows, DOCS), LIMITS).collect()}
    assert set(got.values()) == {6}


def test_copies_alone_make_no_line_frequent(spark):
    rows = [(i, "one page copied often\nwith two lines", "en", "h", 0) for i in range(600)]
    assert {r["left_words"] for r in linefreq.quality(spark.createDataFrame(rows, DOCS), LIMITS).collect()} == {7}


def test_texts_that_stay_go_on_without_frequent_lines(spark):
    rows = [(i, f"Menu of  page 12\nown {word(i)} words here\n\nlast {word(i + 9)} words and more", "en", "h", i) for i in range(60)]
    rows += [(100, "Menu of  page 12\nalone on its host", "en", "other", 1), (101, "Menu of  page 12\nno host", "en", None, 2)]
    got = {r["doc_id"]: tuple(r)[1:] for r in linefreq.keep_good(spark.createDataFrame(rows + rows[:1], DOCS), LIMITS).collect()}
    want = {i: (t.removeprefix("Menu of  page 12\n") if s == "h" else t, lang, s, n) for i, t, lang, s, n in rows}
    assert got == want
    assert linefreq.keep_good(spark.createDataFrame(rows + rows[:1], DOCS), LIMITS).count() == len(rows) + 1


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_rows_change_in_one_python_step(spark, monkeypatch, bits):
    """With a filter of 64 bits nearly all rows pass it, and the join that follows puts it right."""
    rows = [(i, f"Menu of page 12\nown {word(i)} words here", "en", "h", i) for i in range(60)] + [(70 + i, "Menu of page 12", "en", "h", 0) for i in range(2)] + [(80, None, "en", "h", 0), (None, "alone", "en", None, 0)]
    docs = spark.createDataFrame(rows + rows[:1], DOCS)
    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    good = linefreq.keep_good(docs, LIMITS)
    assert good._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1, "a task with two of them holds two workers"
    want = Counter((i, t.removeprefix("Menu of page 12\n"), *rest) for i, t, *rest in rows + rows[:1] if t and t != "Menu of page 12")
    assert Counter(map(tuple, good.collect())) == want


def test_screened_rows(spark):
    keys = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    rows = spark.range(1000).select("id", F.when(F.col("id") != 14, F.col("id")).alias("key"))
    maybe, others = (x.collect() for x in shared.screened(rows, "key", keys, "k"))
    assert {r["id"] for r in maybe} >= set(range(0, 1000, 7)) - {14} and 14 in {r["id"] for r in others} and len(maybe) < 160
    assert sorted(r["id"] for r in maybe + others) == list(range(1000))
    assert shared.screened(rows, "key", keys.limit(0), "k")[0].count() == 0
