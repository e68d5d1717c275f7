"""Removal of repeated passages against windows compared as text."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagelathe.llm import batches, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=13):
    """By row: words, those removed, the text that is left."""
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def made(seed=5, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["ab", "ba", "日本", "x y"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(13, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((rng.randint(-50, 400), rng.choice([" ", "\n", "\t \r\n"]).join(w)))
    rows += [(7, rows[0][1]), (7, rows[0][1]), (900, rows[3][1]), (901, None), (902, ""), (903, " \n "), (None, rows[4][1]), (904, "the " * 40), (905, "the " * 13), (906, " ".join(passages[0]) * 400)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [300, 5 << 20])
def test_against_windows_as_text(spark, monkeypatch, size):
    monkeypatch.setattr(batches, "BATCH_BYTES", size)
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("part", substrings.F.lit(1)).withColumn("batch", substrings.F.lit("x"))
    got = substrings.remove_repeats(df).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=repr) == brute(rows)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] and all(0 <= s["start"] < s["stop"] <= r["n_words"] for s in r["spans"]) for r in got)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    """With 16 cells nearly all windows are estimated to repeat; the exact groups put it right."""
    rows = made(9, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substrings, "CELLS", 16)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substrings.remove_repeats(df).collect()), key=repr)
    assert got == brute(rows)


def test_estimates_are_never_too_small():
    rng = np.random.default_rng(2)
    held = [np.unique(rng.integers(0, 5000, 800, dtype=np.uint64)) for _ in range(4)]
    many = [rng.random(len(k)) < 0.1 for k in held]
    table = substrings._table([(3, i, substrings.pack_sorted(k), np.packbits(m).tobytes(), None) for i, (k, m) in enumerate(zip(held, many, strict=True))])
    out = substrings.estimated(table).to_pylist()
    for i, k in enumerate(held):
        bits = np.unpackbits(np.frombuffer(out[i]["a"], np.uint8), count=len(k)).astype(bool)
        true = np.array([many[i][j] or sum(v in set(h.tolist()) for h in held) > 1 for j, v in enumerate(k.tolist())])
        assert (bits | ~true).all()


def test_hashes_do_not_depend_on_where_a_word_stands():
    words = ["aa", "b", "aa", "ab", "ba", "b" * 100, "é"]
    for text in (" ".join(words), "  ".join(["zz"] * 999 + words)):
        data = np.frombuffer(text.encode(), np.uint8)
        s, e, _ = substrings.word_spans(data, np.array([0, len(data)]))
        h = substrings.word_hashes(data, s, e, 0)[-len(words) :]
        assert h[0] == h[2] and len(set(h.tolist())) == len(words) - 1
        first = h if text.startswith("aa") else first
    assert (first == h).all()


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_come_back_from_batches(spark):
    rows = made()
    back = []
    for r in batches.text_batches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        back += zip(r["doc_ids"], batches.text_of(r["data"], r["sizes"]).to_pylist(), strict=True)
    assert sorted(back, key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert isinstance(batches.text_of(r["data"], r["sizes"]), pa.Array)
