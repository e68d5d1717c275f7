"""Language-model scores by a weighted backoff automaton over word trigrams.

Counts of a corpus do not fit on one machine, so neither the vocabulary nor the n-grams are ever broadcast. Texts are
read in batches. A batch asks for what it needs: its distinct words, and its distinct pairs of words with the words after
each, as hashes, go to the parts of the hash range, in one row for each batch and part that has any (so never more rows than
n-grams, however many batches and parts there are); a part merges what all batches have sent and answers each with the corpus
counts. The batch's texts then have all states and arcs that they
can visit, and go through their automaton from left to right. One exchange of distinct n-grams there, one of counts back.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.batches import pack, pack_sorted, text_batches, text_of, unpack, unpack_sorted
from pagelathe.llm.shared import TO_LOWER, bounded, byte_view, give_back, materialize, word_codes, word_spans

#: Bits of the hash that names a pair of words, and of the one that names a word after it; on its own a word has 64.
PAIR_BITS, NEXT_BITS = 48, 24
#: Text of the corpus for each part of the hash range.
PART_BYTES = 16 << 20
#: Tokens of a text that are read in one go; the next ones begin with the two tokens before them.
SEGMENT = 256
def mixed(h: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Batch:
    """Texts as ranks into the sorted hashes of their distinct words; `end` closes each text and opens it as context.

    Pairs are numbered by their hashes, triples by their pair and then the name of their last word, as they are sent.
    """

    def __init__(self, texts: pa.Array) -> None:
        data, offs = byte_view(texts)
        data = TO_LOWER[data]
        starts, ends, first = word_spans(data, offs)
        codes, distinct = word_codes(data, starts, ends)
        digest = xxhash.xxh64_intdigest
        hashes = np.array([*(digest(w) for w in distinct.to_pylist()), digest(b" ")], np.uint64)  # no word is a blank: the end
        self.hashes, rank = np.unique(hashes, return_inverse=True)
        self.end = int(rank[-1])
        self.bounds = first + np.arange(len(first))
        self.ranks = ranks = rank[np.insert(codes, first[1:], len(hashes) - 1)]
        before = np.empty_like(ranks)
        before[1:] = ranks[:-1]
        before[self.bounds[:-1]] = self.end
        own = mixed(self.hashes)
        self.pairs, at, self.pair = np.unique(mixed(own[before] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[ranks]) >> np.uint64(64 - PAIR_BITS), return_index=True, return_inverse=True)
        self.left, self.right = before[at], ranks[at]  # the words of each pair
        inner = np.ones(len(ranks), bool)
        inner[self.bounds[:-1]] = False
        self.inner = np.flatnonzero(inner)  # tokens with two before them, the end mark before the text included
        name = (own & np.uint64((1 << NEXT_BITS) - 1)).astype(np.int64)
        key, at, self.triple = np.unique(self.pair[self.inner - 1] << NEXT_BITS | name[ranks[self.inner]], return_index=True, return_inverse=True)
        self.of_pair, self.next = key >> NEXT_BITS, key & ((1 << NEXT_BITS) - 1)
        self.word, self.last = ranks[self.inner][at], self.pair[self.inner][at]  # a triple's last word, and the pair that ends it


def fold(ids: pa.Array, modulus: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids.to_pylist()], np.int64)


WORDS, PAIRS, TEXTS, TOTALS = 0, 1, 2, 3
ROWS = "part long, batch long, kind int, a binary, b binary, c binary, d binary, doc_ids array<long>"
#: Exponents for which the words' counts are summed; see spread().
POWERS = tuple(round(0.3 + 0.05 * i, 2) for i in range(15))


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.rsplit(" ", 1) for f in names.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def ask(held: DataFrame, part_bits: int, modulus: int, left_out: int) -> DataFrame:
    """For each batch and part the batch's distinct words, pairs and triples with their counts in training texts."""
    parts = np.arange(1 << part_bits, dtype=np.uint64)

    def asked(name: int, batch: Batch, trains: np.ndarray) -> Iterator[tuple]:
        cut = [*np.searchsorted(batch.hashes >> np.uint64(64 - part_bits), parts).tolist(), len(batch.hashes)]
        count = np.bincount(batch.ranks, trains, len(batch.hashes))
        for p, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
            if y > x:
                yield p * 2 + WORDS, name, WORDS, pack_sorted(batch.hashes[x:y]), pack(count[x:y]), None, None, None
        cut = [*np.searchsorted(batch.pairs >> np.uint64(PAIR_BITS - part_bits), parts).tolist(), len(batch.pairs)]
        count = np.bincount(batch.pair, trains, len(batch.pairs))
        triples = np.bincount(batch.triple, trains[batch.inner], len(batch.next))
        after = np.bincount(batch.of_pair, minlength=len(batch.pairs))
        first = np.concatenate([[0], np.cumsum(after)])
        for p, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
            if y > x:
                i, j = first[x], first[y]
                yield p * 2 + PAIRS, name, PAIRS, pack_sorted(batch.pairs[x:y]), pack(np.concatenate([count[x:y], after[x:y]])), pack(batch.next[i:j]), pack(triples[i:j]), None

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                batch = Batch(text_of(row["data"], row["sizes"]))
                trains = np.repeat(fold(pa.array(row["doc_ids"], pa.int64()), modulus) != left_out, np.diff(batch.bounds))
                yield _rows(list(asked(row["batch"], batch, trains)), ROWS)

    return held.mapInArrow(bounded(run), ROWS)


def told(held: DataFrame) -> DataFrame:
    """The texts of each batch, to meet the answers that it gets."""
    none = F.lit(None).cast("binary")
    return held.select(F.lit(-1).cast("long").alias("part"), "batch", F.lit(TEXTS).alias("kind"), F.col("data").alias("a"), F.col("sizes").alias("b"), none.alias("c"), none.alias("d"), "doc_ids")


def answer(table: pa.Table) -> pa.Table:
    """One part of one kind: the counts of all batches merged, and each batch's n-grams answered in its order.

    a: counts of the words or pairs; for pairs b: how many different words follow each in training, c: counts of the triples.
    One more row has totals: of words, occurrences, distinct ones and for each of POWERS the sum of the counts so raised;
    of pairs, distinct ones, and how many pairs, and triples, occur once and twice.
    """
    part, kind = table.column("part")[0].as_py(), table.column("kind")[0].as_py()
    names, raw = table.column("batch").to_pylist(), {c: table.column(c).to_pylist() for c in "abcd"}
    keys = [unpack_sorted(x) for x in raw["a"]]
    ends = np.cumsum([len(k) for k in keys]).tolist()
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    given = [unpack(x).astype(np.int64) for x in raw["b"]]
    counts = np.bincount(place, np.concatenate([g[: len(k)] for g, k in zip(given, keys, strict=True)]), len(distinct)).astype(np.int64)
    if kind == WORDS:
        rows = [(part, name, kind, pack(counts[place[e - len(k) : e]]), None, None, None, None) for name, k, e in zip(names, keys, ends, strict=True)]
        some = counts[counts > 0].astype(np.float64)
        total = [int(counts.sum()), len(some), *(int(round((some**b).sum())) for b in POWERS)]
    else:
        after = [g[len(k) :] for g, k in zip(given, keys, strict=True)]
        triples, at = np.unique(np.repeat(place, np.concatenate(after)) << NEXT_BITS | np.concatenate([unpack(x) for x in raw["c"]]).astype(np.int64), return_inverse=True)
        seen = np.bincount(at, np.concatenate([unpack(x) for x in raw["d"]]), len(triples)).astype(np.int64)
        follow = np.bincount(triples >> NEXT_BITS, seen > 0, len(distinct)).astype(np.int64)
        rows, to = [], 0
        for name, k, e, r in zip(names, keys, ends, after, strict=True):
            own, x, to = place[e - len(k) : e], to, to + int(r.sum())
            rows.append((part, name, kind, pack(counts[own]), pack(follow[own]), pack(seen[at[x:to]]), None, None))
        total = [int((counts > 0).sum()), *(int((c == k).sum()) for c in (counts, seen) for k in (1, 2))]
    give_back()
    return pa.Table.from_batches([_rows([*rows, (part, -1 - part, TOTALS + kind, pack(np.array(total)), None, None, None, None)], ROWS)])


def discount(n1: int, n2: int) -> float:
    """What is taken off every count, from how many n-grams occur once and twice: the leave-one-out estimate of absolute discounting.

    It is the same for all counts: with one for each count an n-gram that occurs twice, as those of a text and its copy do,
    would be worth no more than one that occurs once, because hardly any occurs three times.
    """
    return min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5


def spread(pairs: int, sums: list[int]) -> float:
    """The power of a word's count that says best how many different words follow it: summed over all words it gives all pairs."""
    at = next((i for i, s in enumerate(sums) if s >= pairs), len(sums) - 1)
    if at == 0 or sums[at] <= sums[at - 1]:
        return POWERS[at]
    low, high = math.log(max(1, sums[at - 1])), math.log(sums[at])
    return POWERS[at - 1] + (POWERS[at] - POWERS[at - 1]) * min(1.0, max(0.0, (math.log(max(1, pairs)) - low) / (high - low)))


@dataclass(frozen=True)
class Model:
    """Training tokens and types, the discounts of pairs and triples, and the spread of the words that follow one."""

    n: int
    v: int
    pairs: float
    triples: float
    power: float


class Automaton:
    """The states and arcs that a batch can visit.

    States are contexts that training has: the root (0), a word (1 + its rank), or a pair of words. An arc of a state is
    a word that training has after it; its weight is the smoothed probability. Any other word takes the failure arc, with weight
    b(h), to the state of the context h' without its first word. After a pair P(w | h) = (c(hw) - D) / c(h) + b(h) P(w | h'), with
    D the discount of triples and b(h) what it takes off all of h's arcs, divided by c(h). After a word
    P(w | h) = (1 - b(h)) c(hw) / c(h) + b(h) P(w), with b(h) = D c(h) ** (power - 1), the discount of pairs for as many followers as
    words of that count have. The root has an arc for every word: P(w) = (c(w) + 1) / (N + V + 1). Each sums to one.
    An arc leads to the longest state that ends the words read.
    """

    def __init__(self, model: Model, batch: Batch, words: np.ndarray, pairs: np.ndarray, follow: np.ndarray, triples: np.ndarray) -> None:
        n_words, n_pairs = len(batch.hashes), len(batch.pairs)
        self.one = (words + 1.0) / (model.n + model.v + 1.0)
        many1 = np.maximum(words, 1).astype(np.float64)
        back1 = np.where(words > 0, np.minimum(1.0, model.pairs * many1 ** (model.power - 1)), 1.0)
        many2 = np.maximum(pairs, 1).astype(np.float64)
        back2 = np.where((pairs > 0) & (follow > 0), model.triples * follow / many2, 1.0)
        two = (1 - back1[batch.left]) * pairs / many1[batch.left] + back1[batch.left] * self.one[batch.right]
        three = np.where(triples > 0, (triples - model.triples) / many2[batch.of_pair], 0.0) + back2[batch.of_pair] * two[batch.last]

        word_state = np.where(words > 0, 1 + np.arange(n_words), 0)
        pair_state = np.where(follow > 0, 1 + n_words + np.arange(n_pairs), word_state[batch.right])
        self.fail = np.concatenate([[0], np.zeros(n_words, np.int64), word_state[batch.right]])
        self.back = np.log10(np.concatenate([[1.0], back1, back2]))
        has2, has3 = pairs > 0, triples > 0
        arcs = np.concatenate([np.arange(n_words), (1 + batch.left[has2]) * n_words + batch.right[has2], (1 + n_words + batch.of_pair[has3]) * n_words + batch.word[has3]])
        order = np.argsort(arcs, kind="stable")
        self.n_words, self.arcs = n_words, arcs[order]
        self.weight = np.log10(np.concatenate([self.one, two[has2], three[has3]]))[order]
        self.to = np.concatenate([word_state, pair_state[has2], pair_state[batch.last[has3]]])[order]
        self.start = int(word_state[batch.end])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading a word in each state, and the log-probabilities: failure arcs until there is an arc."""
        state, got, after = state.copy(), np.zeros(len(state)), np.empty_like(state)
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * self.n_words + word[todo]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            done = todo[hit]
            got[done] += self.weight[at[hit]]
            after[done] = self.to[at[hit]]
            todo = todo[~hit]
            got[todo] += self.back[state[todo]]
            state[todo] = self.fail[state[todo]]
        return after, got

    def walk(self, batch: Batch) -> np.ndarray:
        """log10 probability of each text: one traversal from left to right, all texts abreast, each carrying its state.

        A state is no longer than two words, so a long text is read in segments abreast as well: one that is not the first
        reads the two tokens before it from the root to be in its state, and counts what comes after.
        """
        size = np.diff(batch.bounds)
        many = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), many)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
        lead = np.where(begin > 0, 2, 0)
        long = np.minimum(SEGMENT, size[text] - begin) + lead
        order = np.argsort(-long, kind="stable")
        text, lead, long = text[order], lead[order], long[order]
        at = batch.bounds[text] + begin[order] - lead
        state, total = np.where(lead > 0, 0, self.start), np.zeros(len(text))
        active = np.searchsorted(-long, -np.arange(1, long[0] + 1), side="right") if len(long) else []
        for k, n in enumerate(active):
            state[:n], got = self.step(state[:n], batch.ranks[at[:n] + k])
            total[:n] += np.where(lead[:n] <= k, got, 0.0)
        return np.bincount(text, total, len(size))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(model: Model, modulus: int, left_out: int):
    """One batch, its texts and all answers: a row of scores for each text."""

    def work(table: pa.Table) -> pa.Table:
        kinds, parts = table.column("kind").to_pylist(), table.column("part").to_pylist()
        raw = {c: table.column(c).to_pylist() for c in "abc"}
        own = kinds.index(TEXTS)
        batch, ids = Batch(text_of(raw["a"][own], raw["b"][own])), table.column("doc_ids")[own].as_py()
        of = {kind: [i for _, i in sorted({parts[i]: i for i, k in enumerate(kinds) if k == kind}.items())] for kind in (WORDS, PAIRS)}
        joined = lambda kind, c: np.concatenate([np.zeros(0, np.int64), *(unpack(raw[c][i]).astype(np.int64) for i in of[kind])])
        words = joined(WORDS, "a")
        automaton = Automaton(model, batch, words, *(joined(PAIRS, c) for c in "abc"))
        at = batch.bounds[:-1]
        known = np.add.reduceat((words[batch.ranks] > 0).astype(np.int64), at)
        base = np.add.reduceat(np.log10(automaton.one)[batch.ranks], at)
        doc = pa.array(ids, pa.int64())
        columns = [doc, pa.array(fold(doc, modulus) == left_out), pa.array(np.diff(batch.bounds)), pa.array(known), pa.array(np.full(len(ids), model.n, np.int64)), pa.array(base), pa.array(automaton.walk(batch))]
        one = pa.Table.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])
        del batch, automaton, raw
        give_back()  # the next batch, or another stage, gets this worker
        return one

    return work


def score(docs: DataFrame, modulus: int = 7, left_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Trained on all rows whose crc32 of the id is not `left_out` modulo `modulus`. Null, empty or blank text: the end
    token alone. Null doc_id: the id is empty text for the split. Repeated rows: rows like others, counted each.
    Empty table: no rows. Other columns are not read. A pair is named by PAIR_BITS of a hash, a word after it by NEXT_BITS; what
    shares a name is one. docs is read once, into batches that are written: settings and scans may change before the result is read.
    """
    held = text_batches(docs)
    size = held.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    part_bits = max(3, math.ceil(math.log2(max(1, size / PART_BYTES))))
    answered = materialize(ask(held, part_bits, modulus, left_out).groupBy("part").applyInArrow(answer, ROWS))
    totals = total_rows(answered)
    words, pairs = totals.get(WORDS, [0] * (2 + len(POWERS))), totals.get(PAIRS, [0] * 5)
    model = Model(words[0], words[1], discount(*pairs[1:3]), discount(*pairs[3:5]), spread(pairs[0], words[2:]))
    return answered.where(f"kind < {TEXTS}").unionByName(told(held)).groupBy("batch").applyInArrow(scores(model, modulus, left_out), SCORES)


def total_rows(answered: DataFrame) -> dict[int, list[int]]:
    """The sums of the totals of all parts, for each kind."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array([[int(x) for x in unpack(raw)] for raw in batch.column("a").to_pylist()], pa.list_(pa.int64()))], names=["kind", "v"])

    rows = answered.where(f"kind >= {TOTALS}").select("kind", "a").mapInArrow(opened, "kind int, v array<long>").select("kind", F.posexplode("v"))
    out: dict[int, list[int]] = {}
    for r in rows.groupBy("kind", "pos").agg(F.sum("col").alias("s")).orderBy("kind", "pos").collect():  # some twenty rows
        out.setdefault(r["kind"] - TOTALS, []).append(r["s"])
    return out
