"""Quality rules: per-text figures, and lines that recur across the documents of a host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.shared import bounded, byte_view, give_back, materialize, screened, slices, texts, word_codes, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: UTF-8 bytes that begin a code point.
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
_DIGITS = re.compile(rb"[0-9]+")


@dataclass(frozen=True)
class Limits:
    """A text fails the base rules below `min_words` words or above `max_repeat_percent` of words in repeated windows.
    A line is above the limits if at least `line_documents` distinct documents of its host, and `line_share` of them,
    have it; a document is depleted if the lines left hold less than `left_share` of its words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    line_documents: int = 20
    line_share: float = 0.005
    left_share: float = 0.3


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated(codes: np.ndarray, n_codes: int, first: np.ndarray, window: int = 3) -> np.ndarray:
    """For each word whether it lies in a window of `window` words that its text has twice or more."""
    n = len(codes)
    out = np.zeros(n, bool)
    if n < window:
        return out
    key, top = codes[: n - window + 1], n_codes
    for k in range(1, window):
        if top * n_codes >= 1 << 62:
            key, top = (lambda u: (u[1], len(u[0])))(np.unique(key, return_inverse=True))
        key, top = key * n_codes + codes[k : n - window + 1 + k], top * n_codes
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    order = at[np.lexsort((key[at], doc[at]))]
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    for k in range(window):
        out[order[twice] + k] = True
    return out


def normal_line(words: list[bytes]) -> bytes:
    """A line as it is counted, from its words in lower case: one blank between words, each number 0."""
    return _DIGITS.sub(b"0", b" ".join(words))


def text_lines(text: str) -> tuple[int, list[tuple[int, int]]]:
    """Number of lines with a word that equal an earlier one; (hash, words) of each distinct line."""
    repeats, seen = 0, set()
    lines: dict[int, int] = {}
    for line in text.split("\n"):
        words = line.lower().encode("utf-8", "surrogatepass").split()
        if not words:
            continue
        repeats += line in seen
        seen.add(line)
        h = line_hash(words)
        lines[h] = lines.get(h, 0) + len(words)
    return repeats, list(lines.items())


def without_lines(text: str, above: set[int]) -> str:
    """text without the lines whose hash is in `above`; all others, blank ones too, stay as they are."""
    return "\n".join(x for x in text.split("\n") if not (w := x.lower().encode("utf-8", "surrogatepass").split()) or line_hash(w) not in above)


def line_hash(words: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(normal_line(words)))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


FIGURES = "doc_id long, host string, rid long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,words:long>>, content long"


def figures(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: the base figures and its distinct lines. rid: a hash of id, host and text; content: of the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                data, offs = byte_view(texts)
                starts, ends, first = word_spans(data, offs)
                codes, words = word_codes(data, starts, ends)
                again = repeated(codes, max(1, len(words)), first)
                points = np.zeros(len(data) + 1, np.int64)
                np.cumsum(FIRST_BYTE[data], out=points[1:])
                sizes = points[ends] - points[starts]
                dup, lines = zip(*(text_lines(t or "") for t in texts.to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("host"), part.column("rid"), pa.array(np.diff(first)), pa.array(sums(sizes, first)),
                        pa.array(sums(SYMBOLS[data], offs)), pa.array(dup, pa.int64()), pa.array(sums(again, first)),
                        pa.array([[{"h": h, "words": n} for h, n in x] for x in lines], pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())]))), part.column("content"),
                    ],
                    names=["doc_id", "host", "rid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "content"],
                )

    return texts(docs.select("doc_id", F.col("source").alias("host"), F.xxhash64("doc_id", "source", "text").alias("rid"), F.xxhash64("text").alias("content"), "text")).mapInArrow(bounded(run), FIGURES)


def quality(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, source, text): rid, the base figures, base_failed, left_words, kept, and
    above: the hashes of its lines above the limits, null without any.

    Lines are normalised and hashed; for each host (source) and line the distinct documents are counted, by a
    hash of their text, so that exact copies count once and do not make a line frequent. left_words is what is left
    without the lines above the limits, and a document that keeps less than `left_share` of its words is rejected.

    Null text: no words, fails. Null source: a host of its own. Null doc_id: a row like others. Rows that repeat an
    id, also with all else equal, each give a row. Empty table: no rows. Other columns are not read.
    """
    limits = limits or Limits()
    rows = materialize(figures(docs))
    lines = rows.select("host", "rid", "content", F.explode("lines").alias("l")).select("host", "rid", "content", "l.*")
    having = lines.select("host", "h", "content").distinct()
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_documents")).withColumnRenamed("host", "host_")
    counts = having.groupBy("host", "h").agg(F.count("*").alias("documents")).where(F.col("documents") >= limits.line_documents)
    above = counts.join(hosts, counts["host"].eqNullSafe(hosts["host_"])).where(F.col("documents") >= limits.line_share * F.col("host_documents")).select(F.col("host").alias("fh"), F.col("h").alias("fl"))
    removed = (
        lines.select("host", "rid", "h", "words")
        .join(above, F.col("host").eqNullSafe(F.col("fh")) & (F.col("h") == F.col("fl")), "left_semi")
        .groupBy("rid", "h").agg(F.max("words").alias("words"))
        .groupBy("rid").agg(F.sum("words").alias("removed"), F.collect_list("h").alias("above"))
        .withColumnRenamed("rid", "r")
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    out = rows.drop("lines", "content").join(removed, F.col("rid") == F.col("r"), "left")
    out = out.withColumn("left_words", F.col("n_words") - F.coalesce("removed", F.lit(0))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("left_words") >= limits.left_share * F.col("n_words"))).drop("r", "removed")


def keep_good(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """docs without the rows that quality() rejects, and their texts without the lines above the limits.

    Only texts that have such a line go through Python; no other column changes.
    """
    found = materialize(quality(docs, limits).where("not kept or above is not null").select(F.col("rid").alias("__rid"), F.col("kept").alias("__kept"), F.col("above").alias("__above")).dropDuplicates(["__rid"]))
    if found.isEmpty():
        return docs

    @F.arrow_udf("string")
    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for text, above in parts:
                yield pa.array([None if t is None or not h else without_lines(t, set(h)) for t, h in zip(text.to_pylist(), above.to_pylist(), strict=True)], pa.string())
        finally:
            give_back()

    rows = docs.withColumn("__row", F.xxhash64("doc_id", "source", "text"))
    # only rows that go or lose lines need an exchange of texts; all others are passed on where they are read
    touched, passed = screened(rows, "__row", found, "__rid")
    some = texts(touched).join(found.hint("merge"), F.col("__row") == F.col("__rid"), "left").where(F.coalesce("__kept", F.lit(True)))
    less = cut(F.when(F.col("__above").isNotNull(), F.col("text")), F.col("__above"))
    some = some.withColumn("text", F.coalesce(less, F.col("text")))
    return passed.select(docs.columns).unionByName(some.select(docs.columns))
