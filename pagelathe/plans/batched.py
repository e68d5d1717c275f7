"""Extraction by jobs of many pages: a provider's cheaper batch interface, with single calls where a job fails.

Rows of a partition are put into jobs. A job is named by a hash of what it asks, so a task that is run again, after a lost executor say, asks for
the job that is there already and pays for nothing twice. All jobs of a partition are handed in before the first is waited for.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.coerce import Field, coerce_row, row_type, validate
from pagelathe.operators.relevance import pruned, query_terms
from pagelathe.plans.provider import Provider, ProviderError, Request, call, model_for, output_budget, parsed, prompt

# The wait before a job is looked at again, its growth and its limit, and when a job is given up, in seconds.
FIRST_WAIT_S, GROWTH, LONGEST_WAIT_S, GIVEN_UP_S = 1.0, 1.5, 30.0, 600.0
#: Pages of a job; tokens of a page's text; jobs of a partition that are open at once.
JOB_PAGES, JOB_BUDGET, OPEN_JOBS = 100, 6_000, 8
DONE, FAILED, RUNNING = "done", "failed", "running"


@dataclass(frozen=True)
class Job:
    """How a job stands: DONE with an answer for each request, in order; FAILED; or RUNNING. tokens: of each answer, if known."""

    state: str
    answers: tuple[dict[str, object] | str | Exception, ...] = ()
    tokens: tuple[int, ...] = ()


class JobProvider(Protocol):
    def submit(self, name: str, requests: list[Request]) -> None:
        """Hands a job in. One of the same name that is there already is the same job: nothing is asked or paid again."""

    def look(self, name: str) -> Job:
        """How the job stands."""


def job_name(requests: list[Request]) -> str:
    """The same for the same requests in the same order, wherever and whenever they are asked."""
    return hashlib.sha256(json.dumps([[r.model, r.output_tokens, r.prompt] for r in requests]).encode()).hexdigest()[:32]


def requests_of(texts: list[str], fields: list[Field], query: list[str]) -> list[Request]:
    """One request for each text, all for the model that the longest one needs, without thinking."""
    cut = [pruned(t, query, JOB_BUDGET) for t in texts]
    model = model_for(max(cut, key=len, default=""))
    return [Request(t, prompt(fields, t), tuple(fields), output_budget(fields), 0, model) for t in cut]


def waited(provider: JobProvider, name: str, sleep: Callable[[float], None], clock: Callable[[], float]) -> Job:
    """The job when it has ended; FAILED if it has not in time."""
    ends, wait = clock() + GIVEN_UP_S, FIRST_WAIT_S
    while (job := provider.look(name)).state == RUNNING:
        if clock() > ends:
            return Job(FAILED)
        sleep(wait)
        wait = min(wait * GROWTH, LONGEST_WAIT_S)
    return job


Answer = tuple[dict[str, object] | None, str | None, str, int]


def answers_of(provider: JobProvider, single: Provider, name: str, requests: list[Request], sleep: Callable[[float], None], clock: Callable[[], float]) -> list[Answer]:
    """(values, error code, model, tokens) for each request: of the job, or all by single calls if any part of it fails."""
    try:
        job = waited(provider, name, sleep, clock)
        if job.state != DONE or len(job.answers) != len(requests):
            raise ProviderError("LLM_ERROR", "the job failed or has another number of answers")
        values = []
        for a in job.answers:
            if isinstance(a, Exception):
                raise a
            values.append(parsed(a))
        tokens = job.tokens if len(job.tokens) == len(requests) else (0,) * len(requests)
        return [(v, None, f"{r.model}-batch", n) for v, r, n in zip(values, requests, tokens, strict=True)]
    except Exception:  # noqa: BLE001  whatever is wrong with a job, its pages are asked one by one
        out: list[Answer] = []
        for r in requests:
            try:
                out.append((call(single, r, sleep, clock), None, r.model, 0))
            except ProviderError as e:
                out.append((None, e.code, r.model, 0))
        return out


def extract_batched(texts: DataFrame, fields: list[Field], provider: JobProvider, single: Provider, query: list[str] | None = None, pages: int = JOB_PAGES, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """texts (text and any others) with data, warnings, error (a code or null), model and tokens: every row asked in one job of its partition.

    A job that fails, is not done in time, or has a wrong or unreadable answer is asked page by page instead, so every row has its own result or error
    code. Null text: asked as empty. Empty table: no rows, no jobs. A column named like a new one is replaced.
    """
    validate(fields)
    query = query_terms(fields) if query is None else query
    names = [f.name for f in fields]
    new = ("said", "error", "model", "tokens", "data", "warnings")
    rows = texts.select(*[F.col(f"`{c}`") for c in texts.columns if c not in new])

    def written(values: dict[str, object] | None) -> list[tuple[str, str | None]] | None:
        if values is None:
            return None
        text = lambda v: None if v is None else v if isinstance(v, str) else "; ".join(map(str, v)) if isinstance(v, list) else str(v)
        return [(n, text(values.get(n))) for n in names]

    def finished(batch: pa.RecordBatch, name: str, requests: list[Request]) -> pa.RecordBatch:
        out = answers_of(provider, single, name, requests, sleep, clock)
        columns = [pa.array([written(x[0]) for x in out], pa.map_(pa.string(), pa.string())), *(pa.array([x[i] for x in out], pa.string()) for i in (1, 2)), pa.array([x[3] for x in out], pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "said", "error", "model", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.RecordBatch, str, list[Request]]] = []
        for part in jobs_of(batches, pages):
            requests = requests_of([t or "" for t in part.column("text").to_pylist()], fields, query)
            name = job_name(requests)
            try:
                provider.submit(name, requests)
            except Exception:  # noqa: BLE001  a job that is not there has no state: its pages are asked one by one
                name = ""
            waiting.append((part, name, requests))
            if len(waiting) == OPEN_JOBS:
                yield finished(*waiting.pop(0))
        for job in waiting:
            yield finished(*job)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    asked = rows.mapInArrow(run, f"{kept}, said map<string,string>, error string, model string, tokens long")
    data, notes = coerce_row(fields, {n: F.try_element_at("said", F.lit(n)) for n in names})
    good = F.col("error").isNull()
    return asked.select(*rows.columns, F.when(good, data).cast(row_type(fields)).alias("data"), F.when(good, notes).otherwise(F.array().cast("array<string>")).alias("warnings"), "error", "model", "tokens")


def jobs_of(batches: Iterator[pa.RecordBatch], pages: int) -> Iterator[pa.RecordBatch]:
    """Rows in lots of `pages`, whatever the Arrow batches are, so that a job has the same rows if its task is run again."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(b.num_rows for b in rest) < pages:
            continue
        whole = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        full = whole.num_rows - whole.num_rows % pages
        for at in range(0, full, pages):
            yield whole.slice(at, pages)
        rest = [whole.slice(full)] if full < whole.num_rows else []
    if rest and (table := pa.Table.from_batches(rest).combine_chunks()).num_rows:
        yield table.to_batches()[0]
