"""The divergence audit against integers of any size, term by term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelathe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top):
    docs = [(t or "", la or "", s or "") for t, la, s in rows]
    seen, count, groups = defaultdict(set), Counter(), defaultdict(set)
    for i, (t, la, s) in enumerate(docs):
        groups[la].add(s)
        for w in TERM.findall(t):
            w = w.translate(LOWER)
            seen[la, w].add(i)
            count[la, s, w] += 1
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for la, sources in groups.items():
        kept = [w for (x, w), d in seen.items() if x == la and len(d) >= 3]
        n = {s: sum(count[la, s, w] for w in kept) for s in sources}
        p = {s: {w: 1 + 10**9 * (count[la, s, w] + 1) // (n[s] + len(kept)) for w in kept} for s in sources}
        total = {w: sum(count[la, s, w] for s in sources) for w in kept}
        q = {w: 1 + 10**9 * (total[w] + 1) // (sum(total.values()) + len(kept)) for w in kept}
        for s in sources:
            pair = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if count[la, s, w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(la, s, part, o, v, k + 1) for k, (o, v) in enumerate(items[:most])]
    return sorted(out)


def made(seed=1, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "é", "日本", "a", "b", *("".join(rng.choice("abcdefÉ") for _ in range(rng.randint(1, 3))) for _ in range(150))]
    own = {s: rng.sample(vocabulary, 25) for s in "pqrstuv"}
    rows = []
    for _ in range(n):
        s = rng.choice("pppppqrstuv")
        words = [rng.choice(own[s] if rng.random() < 0.5 else vocabulary) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([" ", ", ", "1"]).join(words), rng.choice(["en", "de", "fr", None, ""]), s))
    rows += [rows[0]] * 30 + [(None, "en", "null text"), ("", "en", "none"), ("one", "xx", "alone"), (None, "yy", "a"), (None, "yy", None), ("x y z", None, None)]
    return rows


@pytest.mark.parametrize("top", [200, 5, 1])
@pytest.mark.parametrize("parts", [1, 6])
def test_against_brute_force(spark, top, parts):
    rows = made()
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(parts).withColumns({c: divergence.F.lit(1) for c in ("term", "count", "rank", "v", "gid")})
    got = divergence.audit(df, top).collect()
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == brute(rows, top)


def test_ties_at_the_last_rank_come_by_bytes(spark):
    rows = [("é b a zz", "en", s) for s in "abc"] + [("é b a", "en", "a")] * 2 + [("zz", "en", "b")] * 3
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), 2).collect()
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == brute(rows, 2)
    assert [r["item"] for r in sorted(got, key=lambda r: r["rank"]) if (r["source"], r["part"]) == ("a", "term")] == ["a", "b"]


def test_long_posting_lists(spark, monkeypatch):
    rows = made(4, 120)
    monkeypatch.setattr(divergence, "PAIRS", 6)
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), 10).collect()
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == brute(rows, 10)


def test_counts_beyond_a_long_times_unit(spark):
    df = spark.createDataFrame([(10**12, 3 * 10**12, 5), (0, 0, 0), (9 * 10**17, 10**18, 7)], "c long, n long, v long")
    got = [r["p"] for r in df.select(divergence.probability("c", "n", "v").alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 1) // max(n + v, 1) for c, n, v in ((10**12, 3 * 10**12, 5), (0, 0, 0), (9 * 10**17, 10**18, 7))]


def test_empty_table_and_no_terms(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    got = divergence.audit(spark.createDataFrame([("rare", "en", "a"), ("12 34", "en", "b")], schema)).collect()
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in got) == [("a", "b", 0, 1), ("b", "a", 0, 1)]
    assert np.all([r["part"] == "pair" for r in got])
