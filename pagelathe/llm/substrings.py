"""Removal of passages that repeat across documents: windows of words, a count-min prefilter, exact groups of the rest.

Three steps over batches of texts, each window a hash:

1. A batch sends its distinct windows to the parts of the hash range, as a sparse sketch: 32 bits of a window, from which the cells of
   all rows of the count-min sketch follow, and whether one of its documents has it or more. A part merges the sketches of all batches and
   answers with a bit for each window: whether documents with it are estimated to be two or more. The estimate is never too small.
2. For windows so estimated only, a batch sends 96 bits and the smallest document id. A part groups them exactly and answers
   with a bit: whether a smaller id is elsewhere.
3. Words covered by a window that starts in a document with a smaller id go.

A batch sends a hot window once, not once for each document, and a part holds a fixed number of windows, so parts grow in number and not in
size. Rows sent are never more than windows, whatever the number of batches and parts, since a part without a window gets none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.batches import pack, pack_sorted, text_batches, text_of, unpack, unpack_sorted
from pagelathe.llm.shared import bounded, byte_view, give_back, materialize, word_spans

#: Windows of all batches that a part of the hash range gets, about; cells of a row of its sketch (a power of two), and rows.
PART_WINDOWS, CELLS, ROWS = 2_000_000, 1 << 22, 4
#: Bits of a window's hash that a sketch is made from, below those that choose the part.
SKETCH_BITS = 32
#: Bytes whose words are hashed at once.
STRETCH = 1 << 20
SALTS = np.random.default_rng(12).integers(0, 1 << 63, ROWS, dtype=np.uint64)
ASK = "part long, batch long, a binary, b binary, c binary"
MANY, LATER = 1, 2
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = tuple(np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))  # odd


def _powers(n: int, odd: int) -> np.ndarray:
    out = np.full(n, odd, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random numbers for its bytes, from differences of running sums."""
    odd = _ODD[seed]
    table = np.random.default_rng(1000 + seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    back = pow(odd, -1, 1 << 64)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, side="right")))
        a, b = int(starts[at]), int(ends[to - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * _powers(b - a, odd), out=total[1:])
        out[at:to] = (total[ends[at:to] - a] - total[starts[at:to] - a]) * _powers(b - a, back)[starts[at:to] - a]
        at = to
    return finished(out ^ (ends - starts).astype(np.uint64) * _MIX[2])


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hash of each run of `width` words."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out *= _MIX[2 + seed]
        out += words[k : k + len(out)]
    return finished(out)


class Batch:
    """A batch's windows: hash, document (its place in the batch) and first word of each, by hash and then by document id."""

    def __init__(self, texts: pa.Array, doc_ids: list, width: int) -> None:
        self.data, offs = byte_view(texts)
        self.starts, self.ends, self.first = word_spans(self.data, offs)
        self.width, self.doc_ids = width, doc_ids
        # ids in order, as unsigned; a null id has no smaller one and is none: its windows are left out
        ids = np.array([0 if i is None else i for i in doc_ids], np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        known = np.array([i is not None for i in doc_ids], bool)
        doc = np.repeat(np.arange(len(doc_ids)), np.diff(self.first))
        h = window_hashes(word_hashes(self.data, self.starts, self.ends, 0), width, 0)
        ok = np.flatnonzero((doc[: len(h)] == doc[width - 1 :]) & known[doc[: len(h)]]) if len(h) else np.zeros(0, np.int64)
        order = np.lexsort((ids[doc[ok]], h[ok]))
        self.at = ok[order]
        self.hash, self.id = h[self.at], ids[doc[self.at]]
        new = np.ones(len(self.hash), bool)
        new[1:] = self.hash[1:] != self.hash[:-1]
        self.new = np.flatnonzero(new)  # where each distinct window begins
        self.group = np.cumsum(new) - 1
        self.distinct = self.hash[self.new]
        self.least = self.id[self.new]  # the smallest id that has it here
        last = self.id[np.append(self.new[1:], len(self.id)) - 1] if len(self.new) else self.least
        self.many = last != self.least

    def second(self, groups: np.ndarray) -> np.ndarray:
        """32 bits of another hash of the windows of some groups."""
        if not len(groups):
            return np.zeros(0, np.uint64)
        h = window_hashes(word_hashes(self.data, self.starts, self.ends, 1), self.width, 1)
        return h[self.at[self.new[groups]]] >> np.uint64(32)

    def cut(self, bits: int, groups: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """(part, from, to) for every part of 2 ** bits that has some of the groups."""
        h = self.distinct if groups is None else self.distinct[groups]
        part = h >> np.uint64(64 - bits)
        at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
        for x, y in zip(at, at[1:], strict=False):
            yield int(part[x]), x, y


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [("part", pa.int64()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, kinds, strict=True)})


def opened(row: dict, width: int) -> Batch:
    return Batch(text_of(row["data"], row["sizes"]), row["doc_ids"], width)


def sketched(held: DataFrame, bits: int, width: int) -> DataFrame:
    """Step 1, from the batches: for each part the windows' bits in order, and whether several documents here have them."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                batch = opened(row, width)
                low = (batch.distinct << np.uint64(bits)) >> np.uint64(64 - SKETCH_BITS)
                yield from _table([(p, row["batch"], pack_sorted(low[x:y]), np.packbits(batch.many[x:y]).tobytes(), None) for p, x, y in batch.cut(bits)]).to_batches()
                del batch

    return held.mapInArrow(bounded(run), ASK)


def estimated(table: pa.Table) -> pa.Table:
    """Step 1, in a part: all batches' sketches merged, and for each batch a bit for each window: two documents or more, as estimated."""
    part, names = table.column("part")[0].as_py(), table.column("batch").to_pylist()
    keys = [unpack_sorted(x) for x in table.column("a").to_pylist()]
    adds = np.concatenate([1 + np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(np.float64) for b, k in zip(table.column("b").to_pylist(), keys, strict=True)])
    every = np.concatenate(keys)
    least = np.full(len(every), np.inf)
    for r in range(ROWS):
        cell = (finished(every + SALTS[r]) & np.uint64(CELLS - 1)).astype(np.int64)
        least = np.minimum(least, np.bincount(cell, adds, CELLS)[cell])
    ends = np.cumsum([len(k) for k in keys]).tolist()
    rows = [(part, name, np.packbits(least[e - len(k) : e] >= 2).tobytes(), None, None) for name, k, e in zip(names, keys, ends, strict=True)]
    del keys, every, adds, least
    give_back()
    return _table(rows)


def flags(replies: list[dict], batch: Batch, bits: int, groups: np.ndarray | None = None) -> np.ndarray:
    """A part's bits for each window (or those of some groups), put together."""
    raw = {r["part"]: r["a"] for r in replies}
    out = [np.unpackbits(np.frombuffer(raw[p], np.uint8), count=y - x).astype(bool) for p, x, y in batch.cut(bits, groups)]
    return np.concatenate(out) if out else np.zeros(0, bool)


def candidates(bits: int, width: int):
    """Step 2, from a batch and its answers: 96 bits and the smallest id of each window that is estimated to be repeated."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([])
        row = left.to_pylist()[0]
        batch = opened(row, width)
        groups = np.flatnonzero(flags(right.to_pylist(), batch, bits))
        more, h, ids = batch.second(groups), batch.distinct[groups], batch.least[groups]
        rows = [(p, row["batch"], pack_sorted(h[x:y]), pack(more[x:y]), pack(ids[x:y])) for p, x, y in batch.cut(bits, groups)]
        del batch
        give_back()
        return _table(rows)

    return work


def grouped(table: pa.Table) -> pa.Table:
    """Step 2, in a part: exact groups; for each batch a bit for each of its windows: whether another batch has a smaller id."""
    part, names = table.column("part")[0].as_py(), table.column("batch").to_pylist()
    keys = [unpack_sorted(x) for x in table.column("a").to_pylist()]
    ends = np.cumsum([len(k) for k in keys]).tolist()
    h = np.concatenate(keys)
    more, ids = (np.concatenate([unpack(x) for x in table.column(c).to_pylist()]) for c in "bc")
    order = np.lexsort((ids, more, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])
    least = np.empty_like(ids)
    least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = least < ids
    rows = [(part, name, np.packbits(later[e - len(k) : e]).tobytes(), None, None) for name, k, e in zip(names, keys, ends, strict=True)]
    del keys, h, more, ids, order, least
    give_back()
    return _table(rows)


OUT = "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:long,stop:long>>"


def cleaned(bits: int, width: int):
    """Step 3, from a batch and all its answers: the texts that are left."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _OUT_KINDS})
        row, replies = left.to_pylist()[0], right.to_pylist()
        batch = opened(row, width)
        groups = np.flatnonzero(flags([r for r in replies if r["step"] == MANY], batch, bits))
        elsewhere = np.zeros(len(batch.distinct), bool)
        elsewhere[groups] = flags([r for r in replies if r["step"] == LATER], batch, bits, groups)
        hit = batch.at[elsewhere[batch.group] | (batch.id > batch.least[batch.group])] if len(batch.at) else batch.at
        edge = np.zeros(len(batch.starts) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = _texts(batch, gone, row["doc_ids"])
        del batch
        give_back()
        return out

    return work


_OUT_KINDS = [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]


def _texts(batch: Batch, gone: np.ndarray, doc_ids: list) -> pa.Table:
    """A row for each text: its kept words joined by a blank, and the runs of removed words."""
    first = batch.first
    lost = np.concatenate([[0], np.cumsum(gone)])[first]
    kept = np.flatnonzero(~gone)
    size = batch.ends[kept] - batch.starts[kept] + 1  # a blank after each word
    to = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(int(to[-1]), 0x20, np.uint8)
    within = np.arange(int(to[-1])) - np.repeat(to[:-1], size)
    body = within < np.repeat(size - 1, size)
    flat[body] = batch.data[(np.repeat(batch.starts[kept], size) + within)[body]]
    ends = to[np.searchsorted(kept, first)]
    raw, texts = flat.tobytes(), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        texts.append(raw[a : max(a, b - 1)])
    turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    inner = first[1:-1]
    opens, shuts = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    # a run that crosses into the next text is one run in each
    split = np.unique(inner[(inner > 0) & (inner < len(gone))])
    split = split[gone[split] & gone[split - 1]] if len(gone) else split
    opens, shuts = np.sort(np.concatenate([opens, split])), np.sort(np.concatenate([shuts, split]))
    of = np.searchsorted(opens, first)
    base = np.repeat(first[:-1], np.diff(of))
    runs = pa.StructArray.from_arrays([pa.array(opens - base), pa.array(shuts - base)], names=["start", "stop"])
    spans = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), runs)
    return pa.table([pa.array(doc_ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(first)), pa.array(np.diff(lost)), spans], names=[n for n, _ in _OUT_KINDS])


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans): every row of docs (doc_id, text) without passages that a document of smaller id has.

    A window is `width` consecutive words of one text. Each word that is covered by a window whose words also start in a document with a smaller
    doc_id goes; windows are judged on the texts as they come, not on what is left. text: the kept words, one blank between.
    spans: runs of removed words, by number from 0, end exclusive. Null or blank text, or fewer than `width` words: nothing removed. Null
    doc_id: neither smaller nor larger than any, nothing removed. Repeated rows, and rows that share an id: none is
    smaller, so they do not remove each other's. Empty table: no rows. Other columns are not read. doc_id is cast to long. A
    batch holds whole texts, so memory follows the longest text. Windows are told apart by 96 bits of two hashes.
    """
    held = text_batches(docs)
    size = held.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = max(3, math.ceil(math.log2(max(1, size / 6 / PART_WINDOWS))))
    many = materialize(sketched(held, bits, width).groupBy("part").applyInArrow(estimated, ASK))
    by_batch = held.groupBy("batch")
    asked = by_batch.cogroup(many.groupBy("batch")).applyInArrow(candidates(bits, width), ASK)
    later = asked.groupBy("part").applyInArrow(grouped, ASK)
    replies = many.withColumn("step", F.lit(MANY)).unionByName(later.withColumn("step", F.lit(LATER)))
    return by_batch.cogroup(replies.groupBy("batch")).applyInArrow(cleaned(bits, width), OUT)
