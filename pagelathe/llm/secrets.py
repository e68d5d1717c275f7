"""Secret scans: regular expressions behind a trigram inverted index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pagelathe.llm.shared import bounded, byte_view, slices, texts
from pagelathe.llm.trigrams import Postings, trigram_query, trigrams_of

#: kind, pattern, whether letters match in either case, group whose length counts, its least length. The first three are the base.
RULES: tuple[tuple[str, str, bool, int, int], ...] = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    ("hex", r"[0-9a-f]{24,}", False, 0, 24),
    ("aws_temporary", r"(?<![A-Z0-9])(?:ASIA|AROA|AIDA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Z0-9])", False, 0, 20),
    ("aws_secret", r"aws_?(?:secret|session)_?(?:access)?_?(?:key|token)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9/+=]{40,}", True, 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", False, 0, 0),
    ("github_fine", r"github_pat_[A-Za-z0-9_]{60,}", False, 0, 0),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", False, 0, 0),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", False, 0, 0),
    ("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", False, 0, 0),
    ("google_api", r"AIza[A-Za-z0-9_-]{35}", False, 0, 0),
    ("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}", False, 0, 0),
    ("google_client", r"[0-9]+-[a-z0-9]{32}\.apps\.googleusercontent\.com", False, 0, 0),
    ("stripe", r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}", False, 0, 0),
    ("stripe_hook", r"whsec_[A-Za-z0-9]{24,}", False, 0, 0),
    ("square", r"sq0(?:atp|csp|idp)-[A-Za-z0-9_-]{22,}", False, 0, 0),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", False, 0, 0),
    ("mailgun", r"key-[0-9a-z]{32}", False, 0, 0),
    ("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}", False, 0, 0),
    ("twilio", r"(?<![A-Za-z0-9])(?:AC|SK)[0-9a-f]{32}(?![A-Za-z0-9])", False, 0, 0),
    ("npm", r"npm_[A-Za-z0-9]{36}", False, 0, 0),
    ("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}", False, 0, 0),
    ("docker", r"dckr_pat_[A-Za-z0-9_-]{27,}", False, 0, 0),
    ("digitalocean", r"do[opr]_v1_[a-f0-9]{64}", False, 0, 0),
    ("shopify", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}", False, 0, 0),
    ("telegram", r"(?<![0-9])[0-9]{8,10}:AA[A-Za-z0-9_-]{33}", False, 0, 0),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----", False, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", False, 0, 0),
    ("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", True, 0, 0),
    ("basic_auth", r"basic\x20+[A-Za-z0-9+/]{20,}={0,2}", True, 0, 0),
    ("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+", True, 0, 0),
    ("connection", r"(?:accountkey|sharedaccesskey)=[A-Za-z0-9+/]{40,}={0,2}", True, 0, 0),
    ("client_secret", r"client_?secret[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._~-]{16,}", True, 0, 0),
    ("private_token", r"(?:auth|access|refresh|private)_?(?:token|key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._~+/-]{16,}", True, 0, 0),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """All spans (start, order of the kind, end) of the rules in each text, in code points."""

    def __init__(self, rules: tuple = RULES) -> None:
        self.rules = [(i, re.compile(p, re.ASCII | (re.IGNORECASE if either else 0)), g, n) for i, (_, p, either, g, n) in enumerate(rules)]
        self.queries = [trigram_query(p, re.ASCII) for _, p, *_ in rules]
        self.postings = Postings(set().union(*map(trigrams_of, self.queries)))

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        self.postings.index(*byte_view(texts))
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        held: dict[int, str] = {}
        for (i, pattern, group, least), query in zip(self.rules, self.queries, strict=True):
            for k in self.postings.texts(query).nonzero()[0].tolist():
                if k not in held:
                    held[k] = texts[k].as_py() or ""
                for m in pattern.finditer(held[k]):
                    if m.end(group) - m.start(group) >= least:
                        out[k].append((m.start(), i, m.end()))
        return [sorted(s) for s in out]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[i]}:{a}:{b}" for a, i, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs.

    Each slice of texts gets an inverted index of the trigrams that the rules' queries name; posting lists are
    intersected and united as each query says, and its pattern runs over the candidates alone. A rule without
    mandatory trigrams runs over all texts. Texts are whole; no shuffle; matches of a rule that are too short go.

    Null or empty text: no spans. Null doc_id and repeated rows: rows like others. Empty table: no rows.
    Other columns are not read.
    """
    kinds = tuple(r[0] for r in RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = scanner().spans(part.column("text"))
                base = [[s for s in x if s[1] < len(BASE)] for x in found]
                count = [[sum(s[1] == k for s in x) for x in base] for k in range(len(BASE))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array([hashlib.sha256(joined(x, kinds).encode()).hexdigest() for x in base], pa.string()), pa.array([joined(x, kinds) for x in found], pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return texts(docs, "doc_id", "text").mapInArrow(bounded(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """text with each run of overlapping spans replaced."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span of scan() replaced in `text`; other columns stay, null texts too."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                found = scanner().spans(texts)
                values = texts.to_pylist() if any(found) else None
                if values:
                    texts = pa.array([redact(t, s, mask) if s else t for t, s in zip(values, found, strict=True)], texts.type)
                yield part.set_column(at, "text", texts)

    return texts(docs).mapInArrow(bounded(run), docs.schema)
