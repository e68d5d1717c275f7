"""Packing tokenised documents into sequences: large items matched in pairs, small ones best-fit into the gaps."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.shared import TO_LOWER, bounded, byte_view, materialize, prefix_sum, rows_per_partition, slices, texts, word_codes, word_spans

#: Characters that the tokenizer's normalizer leaves alone or lower-cases one by one; words with others take the long way.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Texts on which a tokenizer's ids must be those of its words, else it is refused.
PROBES = ("The quick brown fox, isn't it?", "it's WE'RE 1,234.5 e-mail", "a  b\t\nc", "naïve café ÉCOLE ß", "中文 текст 😀", "x" * 40 + "--..!!", "(a)b's'd'll <b>c</b>", "")
#: Entries after which a worker's memory of words starts anew.
REMEMBERED = 300_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of the words of texts. Each distinct word of a slice is tokenised once: white space never joins two words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        model = json.loads(self.whole.to_str())["model"]
        if not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: words cannot be tokenised one by one without a mark for their end; only tokenizers of the word_bpe kind can be used")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pieces = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
        self.letters = byte_letters()
        self.kind = np.uint16 if len(model["vocab"]) <= 1 << 16 else np.uint32
        self.seen: dict[bytes, bytes] = {}
        ids, at = self.flat(pa.array(PROBES), 1)
        if any(ids[at[i] : at[i + 1]].tolist() != [*self.whole.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(PROBES)):
            raise ValueError(f"{path}: this tokenizer does not work word by word; only those of the word_bpe kind can be used")

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def piece(self, raw: bytes) -> bytes:
        """Ids of one pre-token in lower case, packed."""
        got = self.seen.get(raw)
        if got is None:
            mapped = raw.decode() if raw.isascii() else "".join(map(self.letters.__getitem__, raw))
            got = self.seen[raw] = self.packed([t.id for t in self.pieces.tokenize(mapped)])
        return got

    def word(self, raw: bytes) -> bytes:
        """Ids of a word, packed."""
        if raw.isalpha():
            return self.piece(raw.lower())
        if raw[:-1].isalpha() and raw[-1:] in b".,;:!?)":
            return self.piece(raw[:-1].lower()) + self.piece(raw[-1:])
        text = raw.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self.piece(p.encode()) for p in PIECE.findall(text.lower())])
        return self.packed(self.whole.encode(text, add_special_tokens=False).ids)

    def flat(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts after one another, `end` after each text, and the n + 1 offsets."""
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        data, offs = byte_view(texts)
        if b"<|" not in memoryview(data).tobytes():  # the special tokens' names are the only words whose case counts
            data = TO_LOWER[data]
        starts, ends, first = word_spans(data, offs)
        codes, distinct = word_codes(data, starts, ends)
        lists = [*map(self.word, distinct.to_pylist()), self.packed([end])]
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // np.dtype(self.kind).itemsize
        ids = np.frombuffer(b"".join(lists), self.kind)
        at = np.cumsum(size) - size
        codes = np.insert(codes, first[1:], len(lists) - 1)  # the end of each text is a word of its own
        many = size[codes]
        total = np.cumsum(many)
        take = np.repeat(at[codes] - (total - many), many) + np.arange(total[-1] if len(total) else 0)
        bounds = np.concatenate([[0], total])[np.concatenate([[0], first[1:] + np.arange(1, len(first))])]
        return ids[take].astype(np.uint32), bounds


@lru_cache(maxsize=4)
def tokenizer(name: str) -> WordTokenizer:
    """The tokenizer of a file, or of a name among the public ones, found where this runs."""
    if "/" in name:
        return WordTokenizer(name)
    import public_tokenizers

    return WordTokenizer(public_tokenizers.path(name))


def pieces(docs: DataFrame, name: str, size: int, end: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name)
        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                ids, bounds = tok.flat(part.column("text"), end)
                length = np.diff(bounds)
                parts = (length + size - 1) // size
                row = np.repeat(np.arange(len(length)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * size
                long = np.minimum(size, length[row] - start)
                at = bounds[row] + start
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), long.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(long), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs, "doc_id", "text").mapInArrow(bounded(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def match(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins for counts[length] items of each length, as (lengths in the bin, number of such bins).

    Items of over a third of a bin go at most two to a bin: the largest left takes the largest partner that fits.
    The others fill the smallest gap that holds them, the largest first. Work follows the number of lengths, not of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    put = lambda items, n: gaps.setdefault(size - sum(items), []).append((items, n)) if n else None
    large = sorted((n for n in left if 3 * n > size), reverse=True)
    for i, n in enumerate(large):
        while left[n]:
            partner = next((m for m in large[i:] if left[m] and n + m <= size and (m != n or left[n] > 1)), None)
            if partner is None:
                put([n], left[n])
                left[n] = 0
                break
            many = left[n] // 2 if partner == n else min(left[n], left[partner])
            put([n, partner], many)
            left[n] -= many
            left[partner] -= many
    for n in sorted((n for n in left if 3 * n <= size), reverse=True):
        todo = left[n]
        for gap in sorted(g for g in gaps if g >= n):
            fits, at = gap // n, 0
            while todo and at < len(gaps[gap]):
                items, bins = gaps[gap][at]
                full = min(bins, todo // fits)
                put([*items, *[n] * fits], full)
                todo -= full * fits
                bins -= full
                if bins and todo:  # fewer than `fits` are left
                    put([*items, *[n] * todo], 1)
                    bins, todo = bins - 1, 0
                gaps[gap][at] = (items, bins)
                at += 1
            gaps[gap] = [x for x in gaps[gap] if x[1]]
            if not todo:
                break
        if todo:
            fits = size // n
            put([n] * fits, todo // fits)
            put([n] * (todo % fits), 1 if todo % fits else 0)
    return [x for group in gaps.values() for x in group if x[1]]


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", size: int = 4096, end: int = 1) -> DataFrame:
    """Each piece of each document with its place: sequence_id and offset, sequences of at most `size` tokens.

    A document is its ids and then `end`; only longer ones than `size` are cut. What goes where is decided on the
    histogram of lengths (`size` numbers at most, whatever the input), as bin patterns with a number of bins. The
    items of a length are ranked by skew-safe prefix counts, and the rank says which bin an item gets, so that no
    task holds a length whole and the patterns' table (bounded by lengths, and checked) is all that is broadcast.

    Null or empty text: the end token alone. Null doc_id: a row like others. Repeated rows each get a place of
    their own. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = materialize(pieces(docs, name, size, end))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    patterns = match(counts, size)
    slots, done, base = [], dict.fromkeys(counts, 0), 0
    for items, bins in patterns:
        at = 0
        for n in items:
            slots.append((n, done[n], done[n] + bins, base - done[n], at))
            done[n] += bins
            at += n
        base += bins
    assert done == counts, "every item has a slot"
    table = spark.createDataFrame(slots, "slot_length long, from_rank long, to_rank long, shift long, offset long")
    ranked = prefix_sum(rows, ["length"], F.lit(1), [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")], "rank", rows_per_partition(docs))
    if len(slots) <= 100_000:
        table = F.broadcast(table)
    on = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    return ranked.join(table, on).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")
