"""License scans: ordered signature rules behind keywords, with overlaps resolved."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelathe.llm.license_rules import BASE, ordered
from pagelathe.llm.shared import TO_LOWER, bounded, byte_view, slices, texts, word_spans
from pagelathe.llm.trigrams import Postings, of_strings, trigrams_of

#: By byte: whether it belongs to a word of this contract: digits, letters and what is not ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Short keywords that their patterns have as whole words only.
WHOLE = frozenset(("cc", "nd", "sa", "nc", "mit", "isc", "sil"))
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Rules:
    """The compiled rules, those of one keyword together, and the postings of the keywords' trigrams."""

    def __init__(self) -> None:
        self.by_key: dict[str, list[tuple[int, str, int, re.Pattern]]] = {}
        for i, (label, priority, key, pattern) in enumerate(ordered()):
            self.by_key.setdefault(key, []).append((i, label, priority, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")))
        # the parts of a keyword of several words may be apart in the raw text; its longest word is looked up
        self.queries = {k: of_strings(frozenset([max(k.split(" "), key=len)])) for k in self.by_key}
        self.postings = Postings(set().union(*map(trigrams_of, self.queries.values())))

    def with_key(self, key: str, low: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Which texts may hold a keyword: by trigrams, or by whole words if it has none."""
        word = max(key.split(" "), key=len)
        if word not in WHOLE:
            return self.postings.texts(self.queries[key]).nonzero()[0]
        starts, ends, first = spans
        at = np.flatnonzero(ends - starts == len(word))
        for i, c in enumerate(word.encode()):
            at = at[low[starts[at] + i] == c]
        return np.unique(np.searchsorted(first, at, side="right") - 1)

    def detect(self, texts: pa.Array, low: np.ndarray, offs: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[list[tuple[int, int, int, int, str]]]:
        """(start, end, priority, rule, label) of each text, word positions, before overlaps are resolved.

        low, offs, spans: the texts' bytes in lower case, their offsets, and the words in them.
        """
        self.postings.index(low, offs)
        plain: dict[int, tuple[str, list[int]]] = {}
        out: list[list[tuple[int, int, int, int, str]]] = [[] for _ in range(len(texts))]
        for key, rules in self.by_key.items():
            for k in self.with_key(key, low, spans).tolist():
                if k not in plain:
                    line = " ".join(_WORDS.findall(low[offs[k] : offs[k + 1]].tobytes().decode()))
                    plain[k] = line, []
                line, blanks = plain[k]
                if key not in line:
                    continue
                for i, label, priority, pattern in rules:
                    for m in pattern.finditer(line):
                        if not blanks and " " in line:
                            blanks.extend(j for j, c in enumerate(line) if c == " ")
                        out[k].append((bisect_right(blanks, m.start()), bisect_right(blanks, m.end() - 1) + 1, priority, i, label))
        return out


def resolve(found: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, int, str]]:
    """The detections that stay: by priority, then length, then place; none that overlaps or lies in an earlier one.

    Base phrases (priority 100) all stay and suppress nothing: a version or a fuller name at their place is kept too.
    """
    base = [x for x in found if x[2] == 100]
    kept: list[tuple[int, int, int, int, str]] = []
    starts: list[int] = []  # of what is kept, in order; intervals are apart, so their ends are in order too
    ends: list[int] = []
    for x in sorted((x for x in found if x[2] < 100), key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
        at = bisect_left(starts, x[0])
        if (at == 0 or ends[at - 1] <= x[0]) and (at == len(starts) or x[1] <= starts[at]):
            starts.insert(at, x[0])
            ends.insert(at, x[1])
            kept.append(x)
    return base + kept


@lru_cache(maxsize=1)
def rules() -> Rules:
    return Rules()


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    score is 0 without a detection, else 1 - product of (1 - priority / 125) over the detections that stay.
    Null or empty text: no words, no labels, score 0. Null doc_id and repeated rows: rows like others. Empty table:
    no rows. Other columns are not read. No shuffle.
    """
    n_base = len(BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                data, offs = byte_view(texts)
                low = TO_LOWER[data]
                spans = word_spans(low, offs, LETTERS)
                words = np.diff(spans[2])
                rows: list[list] = [[] for _ in range(6)]
                for found in rules().detect(texts, low, offs, spans):
                    base = [x for x in found if x[3] < n_base]
                    stay = resolve(found)
                    at = [x[0] for x in base]
                    values = (
                        len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x[4] for x in base})),
                        ",".join(sorted({x[4] for x in stay})), 1 - float(np.prod([1 - x[2] / 125 for x in stay])) if stay else 0.0,
                    )
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return texts(docs, "doc_id", "text").mapInArrow(bounded(run), SCHEMA)
