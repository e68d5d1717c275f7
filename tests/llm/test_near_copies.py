"""Near copies are linked by their exact shingles, whatever their fingerprints say."""

import numpy as np
import pyarrow as pa
import pytest

from pagelathe.llm import shared, simhash
from pagelathe.llm.components import forest, span_links

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def edited(words, times, rng):
    """words with so many of them replaced, far enough apart that each takes five shingles."""
    w = list(words)
    for at in rng.choice(len(w) // 6, times, replace=False) * 6 + 3:
        w[at] = f"new{rng.integers(1 << 40)}"
    return " ".join(w)


def test_pairs_below_the_limit_both_stay_and_those_above_are_caught(spark):
    rng = np.random.default_rng(7)
    rows, below, above = [], [], []
    for i in range(400):
        base = [f"w{x}" for x in rng.integers(0, 50_000, 404)]
        # 400 shingles, 5 lost for each edit: 0.77 at 10 edits, 0.82 at 8
        times, pairs = ((10, below), (8, above))[i % 2]
        pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(base), "en", "s", 0), (2 * i + 1, edited(base, times, rng), "en", "s", 0)]
    text = {r[0]: r[1] for r in rows}
    assert all(0.75 < jaccard(text[a], text[b]) < 0.8 for a, b in below) and all(0.8 < jaccard(text[a], text[b]) < 0.83 for a, b in above)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert all({a, b} <= kept for a, b in below), "below 0.8 nothing goes"
    assert sum(b not in kept for _, b in above) >= 0.97 * len(above)


def test_repeats_do_not_count():
    h, counts = simhash.shingle_slice(pa.array(["x y x y x y", "x y", "", None, "y"]), 2, 1)
    assert [len(x) for x in simhash.shingle_sets(h, counts)] == [2, 1, 0, 0, 1]
    assert [len(x) for x in simhash.band_keys(simhash.shingle_sets(h, counts), 10, 4)] == [10, 10, 0, 0, 10]


def test_links_span_what_is_similar():
    sets = [np.arange(0, 100), np.arange(10, 110), np.arange(20, 120), np.arange(500, 600), np.zeros(0, np.int64)]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    left, right, tree = forest(5, simhash.similar_sets(np.concatenate(sets), offs, 0.8))
    assert sorted(zip(left, right, strict=True)) == [(0, 1), (1, 2)] and tree.tolist() == [0, 0, 0, 3, 4]


def test_bands_meet_nearly_all_pairs_at_the_limit():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(400):  # 360 of 440 shingles: a similarity of 0.8
        h = rng.integers(0, 1 << 63, 440, dtype=np.uint64)
        a, b = simhash.band_keys([np.sort(h[:400]), np.sort(h[40:])], 10, 4)
        met += bool((a == b).any())
    assert met >= 0.98 * 400


def test_rows_are_named_by_id_and_text(spark):
    rng = np.random.default_rng(9)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 9999, 80)) for _ in range(2))
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a.upper(), "en", "s", 1), (1, b + " end", "en", "s", 2), (None, a, "en", "s", 3), (7, None, "en", "s", 0), (8, "", "en", "s", 0), (1, a, "en", "s", 4)]
    got = sorted((r["doc_id"], (r["text"] or "")) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert [i for i, _ in got] == [1, 1, 7] and got[0][1] != got[1][1]
    assert {x[1].removesuffix(" end") for x in got[:2]} == {a, b}
    assert simhash.drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_large_groups_keep_their_links(spark):
    """An original and its variants, which link with it but not with each other; and unlike texts in the same group."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 300)
    sets = [base, *(np.concatenate([base[rng.permutation(300)[:270]], rng.integers(0, 1 << 62, 30)]) for _ in range(150)), *(rng.integers(0, 1 << 62, 300) for _ in range(50))]
    sets = [np.sort(s).astype(np.uint64) for s in sets]
    payload = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "pid long, shingles binary").cache()
    for weigh in (0, 1):  # with the original as a hub, and without
        members = payload.selectExpr("1L as gid", "pid", f"if(pid = 0, {weigh}L, 0L) as weight")
        links = span_links(members, payload, simhash.set_links(0.8), 24, 4).collect()
        up = {frozenset((r["a"], r["b"])) for r in links if r["a"] != r["b"]}
        want = {frozenset((i, j)) for i in range(201) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
        assert up <= want and {min(x) for x in up if 0 in x} == {0}
        assert len({max(x) for x in up if 0 in x}) == 150


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_rows_go_without_python(spark, monkeypatch, bits):
    rng = np.random.default_rng(11)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 9999, 80)) for _ in range(3))
    rows = [(1, a, "en", "s", 0), (2, a + " end", "en", "s", 0), (3, b, "en", "s", 0), (3, b, "en", "s", 0), (4, c, "en", "s", 0), (None, a, "en", "s", 0)]
    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert "EvalPython" not in left._jdf.queryExecution().optimizedPlan().toString(), "texts do not pass through a worker"
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted([(1, a), (3, b), (4, c)])
