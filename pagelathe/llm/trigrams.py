"""Boolean trigram queries of regular expressions, and an inverted index of the trigrams that they name."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from itertools import product

import numpy as np

from pagelathe.llm.shared import TO_LOWER

try:  # the standard library's parser of patterns; it has moved before
    from re import _constants as op
    from re import _parser
except ImportError:
    import sre_constants as op
    import sre_parse as _parser

#: Larger sets of strings are given up for what is known of their parts.
MOST_STRINGS = 48
#: A query: True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple[str, tuple]


def both(*parts: Query) -> Query:
    flat = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def either(*parts: Query) -> Query:
    flat = list(dict.fromkeys(parts))
    return True if True in flat or not flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def of_strings(strings: frozenset[str]) -> Query:
    """Some of the strings occurs: the trigrams of one of them all do. A string under three letters says nothing."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


@dataclass(frozen=True)
class Known:
    """What a part of a pattern says of its match: all it can be (or None), how it begins and ends, and a query."""

    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: Query = True

    @property
    def heads(self) -> frozenset[str]:
        return self.exact if self.exact is not None else self.begins

    @property
    def tails(self) -> frozenset[str]:
        return self.exact if self.exact is not None else self.ends

    def loose(self) -> Known:
        """Without `exact`; what it said goes into the rest."""
        if self.exact is None:
            return self
        return Known(None, _cut(self.exact, head=True), _cut(self.exact, head=False), both(self.query, of_strings(self.exact)))


NOTHING = frozenset({""})
ANY = Known(None, NOTHING, NOTHING)
EMPTY = Known(NOTHING, NOTHING, NOTHING)


def _cut(strings: frozenset[str], head: bool) -> frozenset[str]:
    got = frozenset(s[:2] if head else s[-2:] for s in strings)
    return got if len(got) <= MOST_STRINGS else NOTHING


def _joined(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x, y in product(a, b)) if len(a) * len(b) <= MOST_STRINGS else None


def then(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and (got := _joined(a.exact, b.exact)) is not None:
        return Known(got, got, got, both(a.query, b.query))
    across = _joined(_cut(a.tails, head=False), _cut(b.heads, head=True))
    query = both(a.loose().query, b.loose().query, of_strings(across) if across else True)
    begins = _joined(a.exact, b.heads) if a.exact is not None else a.begins
    ends = _joined(a.tails, b.exact) if b.exact is not None else b.ends
    return Known(None, _cut(begins or NOTHING, head=True), _cut(ends or NOTHING, head=False), query)


def one_of(parts: list[Known]) -> Known:
    if all(p.exact is not None for p in parts):
        strings = frozenset().union(*(p.exact for p in parts))
        if len(strings) <= MOST_STRINGS:
            return Known(strings, strings, strings, either(*(p.query for p in parts)))
    parts = [p.loose() for p in parts]
    return Known(None, _cut(frozenset().union(*(p.begins for p in parts)), head=True), _cut(frozenset().union(*(p.ends for p in parts)), head=False), either(*(p.query for p in parts)))


def letters(items: list) -> Known:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST_STRINGS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return ANY
    strings = frozenset(found)
    return Known(strings, strings, strings) if len(strings) <= 8 and all(s.isascii() for s in strings) else ANY


def known(tree) -> Known:
    out = EMPTY
    for kind, value in tree:
        if kind is op.LITERAL:
            part = letters([(kind, value)])
        elif kind is op.IN:
            part = letters(value)
        elif kind is op.SUBPATTERN:
            part = known(value[-1])
        elif kind is op.BRANCH:
            part = one_of([known(t) for t in value[1]])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = known(inner)
            if most == 1:
                part = one if least else one_of([EMPTY, one])
            elif not least:
                part = ANY
            else:
                part = one
                for _ in range(min(least, 8) - 1):
                    part = then(part, one)
                part = part if least == most <= 8 else then(replace(part.loose()), ANY)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            part = EMPTY
        else:
            part = ANY
        out = then(out, part)
    return out


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """A condition on lower-case trigrams that every text with a match meets; True if there is none."""
    return known(_parser.parse(pattern, flags)).loose().query


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*(trigrams_of(q) for q in query[1]))
    return {query} if isinstance(query, str) else set()


class Postings:
    """For a slice of texts, which of them hold which of the named trigrams, ASCII letters in lower case."""

    def __init__(self, names: set[str]) -> None:
        self.row = {t: i for i, t in enumerate(sorted(names))}
        self.look = np.zeros(1 << 24, np.uint16)
        for t, i in self.row.items():
            a, b, c = t.encode("latin-1")
            self.look[a << 16 | b << 8 | c] = i + 1

    def index(self, data: np.ndarray, offs: np.ndarray) -> None:
        low = TO_LOWER[data].astype(np.uint32)
        n = len(offs) - 1
        self.has = np.zeros((len(self.row) + 1, n), bool)
        self.n = n
        if len(low) < 3:
            return
        codes = self.look[(low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]]
        at = np.flatnonzero(codes)
        doc = np.searchsorted(offs, at, side="right") - 1
        inside = at + 3 <= offs[doc + 1]
        self.has[codes[at[inside]], doc[inside]] = True

    def texts(self, query: Query) -> np.ndarray:
        """Whether each text meets the query: intersections and unions of posting lists."""
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, str):
            return self.has[self.row[query] + 1]
        parts = [self.texts(q) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def compiled(pattern: str, flags: int = re.ASCII) -> re.Pattern:
    return re.compile(pattern, flags)
