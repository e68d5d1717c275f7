"""Null fields are filled from pictures: who is asked, for what, with which bytes."""

import pytest
from pyspark.sql import functions as F

from pagelathe.functions.coerce import Field, row_type
from pagelathe.plans import vision

FIELDS = [Field("price", "float"), Field("color", "string")]
RESULT = f"page_id long, status string, data {row_type(FIELDS)}, warnings array<string>"


def seer(fails=False):
    class Seer:
        def see(self, request, pictures):
            if fails:
                raise RuntimeError("503")
            assert pictures and "<page_content>" in request.prompt
            return '{"price": "%s", "color": null}' % (b"+".join(p[0] for p in pictures).decode() + "," + ".".join(f.name for f in request.fields))

    return Seer()


def page(i, *names):
    return (i, "https://a.com/p", "".join(f'<img src="/{n}" width="{400 - k}" height="400">' for k, n in enumerate(names)))


def tables(spark):
    pages = spark.createDataFrame([page(1, "a.jpg", "b.jpg", "c.jpg", "d.jpg"), page(2, "a.jpg"), page(3, "none.jpg"), page(4, "big.jpg", "a.jpg"), page(5, "a.jpg"), page(6), page(6, "a.jpg"), (7, None, None)], "page_id long, url string, html string")
    files = spark.createDataFrame([(f"https://a.com/{n}.jpg", "image/x", bytes(n, "ascii") * k) for n, k in (("a", 1), ("b", 1), ("c", 1), ("d", 1), ("big", vision.IMAGE_BYTES))], "url string, mime string, bytes binary")
    results = spark.createDataFrame(
        [(1, "success", (None, "red"), ["w"]), (2, "success", (2.0, "red"), []), (3, "success", (None, None), []), (4, "success", (None, None), []), (5, "error", None, []), (7, "success", (None, None), []), (None, "success", (None, None), [])], RESULT
    )
    return results, pages, files


def test_who_is_asked_for_what(spark):
    results, pages, files = tables(spark)
    asked = vision.filled(results, pages, files, FIELDS, seer())
    got = {r["page_id"]: (r["data"] and tuple(r["data"]), r["pictures"], len(r["warnings"])) for r in asked.collect()}
    # the answer is no number, so it is a warning: it names the pictures, of which the best three come, and the fields that were null
    assert got == {1: ((None, "red"), 3, 2), 2: ((2.0, "red"), 0, 0), 3: ((None, None), 0, 0), 4: ((None, None), 1, 1), 5: (None, 0, 0), 7: ((None, None), 0, 0), None: ((None, None), 0, 0)}
    notes = {r["page_id"]: r["warnings"][-1:] for r in asked.collect()}
    assert "a+b+c,price'" in notes[1][0] and "a,price.color'" in notes[4][0]
    assert asked.columns == ["page_id", "status", "data", "warnings", "pictures"]


@pytest.mark.parametrize("empty", [False, True])
def test_failed_calls_and_empty_tables_change_nothing(spark, empty):
    results, pages, files = tables(spark)
    out = vision.filled(results, pages.where(F.lit(not empty)), files, FIELDS, seer(fails=True)).drop("pictures")
    key = lambda r: (r["page_id"] is None, r["page_id"] or 0)
    assert [tuple(r) for r in sorted(out.collect(), key=key)] == [tuple(r) for r in sorted(results.collect(), key=key)]
    assert vision.filled(results.limit(0), pages, files, FIELDS, seer()).count() == 0
