"""The pipeline against a brute-force version of each stage, on what the stage before it kept."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pagelathe.llm import secrets
from pagelathe.llm.linefreq import Limits
from pagelathe.llm.shared import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    """The rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    menu = [(8000 + i, f"own {chr(97 + i)}{chr(98 + i)} start\nthe menu of this host: " + "home news about " * 30 + f"\nand {chr(99 + i) * 4} ends", "en", "menus", 0) for i in range(22)]
    wordy = docs.where("length(text) > 400").first()["text"]
    odd = [(9001, None, "en", "web", 0), (9002, "", "en", "web", 0), (9003, wordy + " token = abcdef123", "en", None, 9), (None, wordy[::-1], "en", "web", 9), (9004, wordy, "en", "web", 9), (9004, wordy, "en", "web", 9)]
    docs = docs.unionByName(spark.createDataFrame(menu + odd, docs.schema)).cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir)).cache())
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_stay(staged):
    assert all(df.columns == staged[0].columns for df in staged[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "packing"]


def test_quality_rules(staged):
    limits, docs = Limits(), rows(staged[0])
    lines, having, of_host = {}, defaultdict(set), Counter()
    for k, (_, text, _, host, _) in enumerate(docs):
        of_host[host] += 1
        lines[k] = [(x, re.sub("[0-9]+", "0", " ".join(WORD.findall(x.lower())))) for x in (text or "").split("\n")]
        for _, x in lines[k]:
            if x:
                having[host, x].add(text)
    often = {key for key, s in having.items() if len(s) >= limits.line_documents and len(s) >= limits.line_share * of_host[key[0]]}
    assert often, "the host of menus has such a line"
    want = Counter()
    for k, row in enumerate(docs):
        w = WORD.findall(row[1] or "")
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n, mark = Counter(win), set()
        for i, x in enumerate(win):
            if n[x] > 1:
                mark |= {i, i + 1, i + 2}
        left = len(w) - sum(len(x.split(" ")) for _, x in lines[k] if (row[3], x) in often)
        if len(w) >= 50 and 100 * len(mark) <= 50 * len(w) and left >= limits.left_share * len(w):
            want[row[0], "\n".join(x for x, y in lines[k] if (row[3], y) not in often), *row[2:]] += 1
    assert Counter(rows(staged[1])) == want


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def test_near_dedup(staged):
    before, after = rows(staged[1]), rows(staged[2])
    assert not Counter(after) - Counter(before)
    sets = [shingles(r[1]) for r in before]
    up = list(range(len(before)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if likeness(a, sets[j]) >= 0.8:
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(before):
        key = (r[0] is None, r[0] or 0)
        least[root(i)] = min(least.get(root(i), key), key)
    assert sorted((r[0] is None, r[0] or 0) for r in after) == sorted(least.values())


def test_secret_scan(staged):
    def clean(text):
        hidden = np.zeros(len(text), bool)
        begin = set()
        spans = sorted((m.start(), m.end()) for _, p, either, g, least in secrets.RULES for m in re.finditer(p, text, re.ASCII | (re.IGNORECASE if either else 0)) if m.end(g) - m.start(g) >= least)
        to = 0
        for a, b in spans:
            if a >= to:
                begin.add(a)
            to = max(to, b)
            hidden[a:b] = True
        return "".join("[secret]" if k in begin else "" if hidden[k] else c for k, c in enumerate(text))

    want = Counter((r[0], clean(r[1]), *r[2:]) for r in rows(staged[2]))
    assert Counter(rows(staged[3])) == want


def test_source_mix(staged):
    docs, mixed = rows(staged[3]), Counter(rows(staged[4]))
    assert not set(mixed) - set(docs)
    size = Counter()
    for r in docs:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(size.values()), set()
    while True:
        rest, w = budget - sum(2 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and rest * weight[s] / w > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in names:
        target = 2 * size[s] if s in full else rest * weight[s] / w
        own = {r: len(WORD.findall(r[1] or "")) for r in docs if r[3] == s}
        taken = sum(mixed[r] * n for r, n in own.items())
        assert target - 1 <= taken <= target + max(own.values()), s
        times = {mixed[r] for r, n in own.items() if n}
        assert max(times) <= 2 and max(times) - min(times) <= 1, s


def test_packing(staged):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok, want, places = Tokenizer.from_file(path("word_bpe_49k.json")), Counter(), defaultdict(list)
    for r in rows(staged[4]):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            want[r[0], p // 4096, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = staged[5].collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 4096
