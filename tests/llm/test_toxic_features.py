"""Every feature of a text against a plain version that reads characters and words one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelathe.llm import toxicity
from pagelathe.llm.toxicity import FEATURES, INSULTS, LEET, NEAR, SECOND_PERSON

LEARNED = {"blorp": 2.5, "ärger": 1.5, "müll": 3.0}


def is_letter(c):
    o = ord(c)
    if o < 128:
        return c.isalpha()
    if o <= 0xBF:
        return c in "ªµº"
    return not (c in "×÷" or 0x2000 <= o <= 0x206F or (0x3000 <= o <= 0x303F and o not in (0x3005, 0x3006, 0x3007)))


def words_of(text):
    out, at = [], None
    for i, c in enumerate(text + " "):
        if is_letter(c) and at is None:
            at = i
        if not is_letter(c) and at is not None:
            out.append((at, i))
            at = None
    return out


def plain(text):
    spans = words_of(text)
    words = [text[a:b].lower() for a, b in spans]
    some, size = max(1, len(words)), max(1, len(text.encode()))
    letters = max(1, sum(len(c.encode()) for c in text if is_letter(c)))
    bad = [i for i, w in enumerate(words) if w in INSULTS or w in LEARNED]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    weights = [LEARNED.get(w, 0.0) for w in words]
    up = [c.isascii() and c.isupper() for c in text]
    shouts = sum(up[i] and up[i + 1] and up[i + 2] and not (i and up[i - 1]) for i in range(len(text) - 2))
    raw = text.encode()
    repeats = sum(raw[i] == raw[i + 1] == raw[i + 2] == raw[i + 3] for i in range(len(raw) - 3))
    gaps = [text[b:c] for (_, b), (c, _) in zip(spans, spans[1:], strict=False)]
    hides = [0 < len(g.encode()) <= 3 and all(c in "0123456789@$!*" for c in g) for g in gaps] + [False]
    single = [len(text[a:b].encode()) == 1 for a, b in spans]
    apart = [len(g.encode()) == 1 for g in gaps] + [False]
    spelled = [i + 3 < len(words) and all(single[i : i + 4]) and all(apart[i : i + 3]) for i in range(len(words))]
    hidden = 0
    for k in range(len(words)):
        if hides[k] or spelled[k]:
            to = k
            while to + 1 < len(words) and (hides[to] or (single[to] and single[to + 1] and apart[to])):
                to += 1
            word = "".join(c for c in text[spans[k][0] : spans[to][1]].lower().translate(LEET) if c.isalpha())
            hidden += word in INSULTS or word in LEARNED
    insults, learned = sum(w in INSULTS for w in words), sum(w > 0 for w in weights)
    return [
        insults, insults / some, learned, learned / some, sum(weights), max(weights, default=0.0), sum(any(abs(i - j) <= NEAR for j in you) for i in bad), len(you) / some,
        sum(up) / letters, shouts / some, text.count("!"), text.count("?"), sum(c in ".,;:!?\"'()[]{}*#-|/" for c in text) / size, repeats / some,
        sum(hides) / some, sum(spelled) / some, hidden, sum(c in "0123456789" for c in text) / size, letters / some, np.log1p(len(words)),
    ]


def made():
    rng = random.Random(8)
    pieces = ["you", "idiot", "IDIOT", "1d10t", "st*pid", "i d i o t", "blorp", "Ärger", "MÜLL", "“", "”", "—", "’", "…", " ", "  ", ".", "!!", "?", "aaaa", "7", "日本", "、", "×", "µ", "you’re", "YOU", "tú", "x", "@", "\n", "#"]
    return ["", " ", "you idiot", "you “idiot”", "you—idiot—you", "«idiot»", "IDIOT!", "a b c d e", "i d i o t!", "w 1 3", "pure 日本、日本"] + ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 40))) for _ in range(300)]


def test_features_one_by_one():
    rows = made()
    got = toxicity.features(pa.array(rows), LEARNED)
    for text, row in zip(rows, got, strict=True):
        for name, a, b in zip(FEATURES, row.tolist(), plain(text), strict=True):
            # an exclamation rate is by words, as others are
            b = b / max(1, len(words_of(text))) if name in ("exclamations", "questions") else b
            assert a == pytest.approx(b), (name, text)


@pytest.mark.parametrize("text", ["you “idiot”", "you—idiot—you", "«idiot»", "idiot’s", "„idiot“…"])
def test_typographic_marks_are_no_letters(text):
    assert toxicity.features(pa.array([text]), {})[0][0] == 1


def test_lexicon_words_are_those_of_the_features(spark):
    rows = [(i, t, i % 2) for i, t in enumerate(made())] + [(1000, None, 1)]
    got = toxicity.distinct_words(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).groupBy("toxic", "w").agg(F.count("*").alias("n")).collect()
    want = {}
    for _, t, y in rows:
        for w in {(t or "")[a:b].lower() for a, b in words_of(t or "")}:
            want[y, w] = want.get((y, w), 0) + 1
    assert {(r["toxic"], r["w"]): r["n"] for r in got} == want
