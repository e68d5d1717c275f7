"""From pages to typed rows: metadata, cleaned text, provider, warnings; for one page, a batch, or a crawl.

Every step works on the row of its page: a page is parsed once, the provider is asked on the same rows, and nothing is
shuffled, so pages that share an id stay apart and a result has a row for each page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.classify import error_row, escalation_reason, null_rate_fires
from pagelathe.functions.coerce import Field, coerce_row, failed, row_type, validate
from pagelathe.operators import content
from pagelathe.operators.metadata import all_facts, known_facts, resolve, skips_rest
from pagelathe.operators.outline import outlined
from pagelathe.operators.relevance import pruned, query_terms
from pagelathe.plans.provider import PatternProvider, Provider, ProviderError, Request, call, model_for, output_budget, prompt, thinking_budget

#: Tokens of text for a first and for a second call.
BUDGETS = (12_000, 24_000)


def parsed(rows: DataFrame, fields: list[Field], carry: tuple[str, ...] = (), embeds: DataFrame | None = None) -> DataFrame:
    """rows (page_id, url, html, code[, headers, cleaned] and `carry`) without html, with facts, text, identifiers and descriptions; nulls where there is a code.

    embeds (endpoint, json): oEmbed answers, joined to the pages that name their endpoints. cleaned: a text that a cache has, null for none.
    """
    wanted = content.wants_description(fields)
    rows = outlined(rows.withColumn("__skip", F.col("code").isNotNull()), skip="__skip")
    if embeds is not None:
        answers = embeds.groupBy(F.col("endpoint").alias("__endpoint")).agg(F.max("json").alias("oembed"))
        named = F.get(F.filter("page.facts", lambda f: f["source"] == "link"), F.lit(0))["value"]
        rows = rows.withColumn("__at", named).join(answers, F.col("__at") == F.col("__endpoint"), "left")
    made = {
        "facts": known_facts(all_facts(rows)),
        "text": F.coalesce(F.col("cleaned"), content.cleaned("page", "url", fields)) if "cleaned" in rows.columns else content.cleaned("page", "url", fields),
        "identifiers": content.identifiers("page", "url"),
        "descriptions": content.descriptions("page") if wanted else F.lit(""),
    }
    return rows.select("page_id", "url", "code", *carry, *[F.when(F.col("code").isNull(), c).alias(n) for n, c in made.items()])


def prompts(docs: DataFrame, fields: list[Field]) -> DataFrame:
    """(doc_id, model, prompt) for docs (doc_id, text): what a provider would be sent for each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(model_for, texts), pa.string()), pa.array([prompt(fields, t) for t in texts], pa.string())], names=["doc_id", "model", "prompt"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, model string, prompt string")


def asked(rows: DataFrame, fields: list[Field], provider: Provider, query: list[str], second: bool = False) -> DataFrame:
    """rows (text, identifiers, descriptions, known, ask) with `said`, a map of the provider's raw values, and `failure`, its error's code; null where `ask` is false."""
    limits = output_budget(fields), thinking_budget(fields), BUDGETS[second]
    names = [f.name for f in fields]

    def answer(text: str, identifiers: str, descriptions: str, known: list) -> tuple[list | None, str | None]:
        output, thinking, budget = limits
        cut = pruned(text or "", query, budget)
        request = Request(cut, prompt(fields, cut, dict(known or ()), identifiers or "", descriptions or ""), tuple(fields), output, thinking, model_for(cut, second))
        try:
            values = call(provider, request)
        except ProviderError as e:
            return None, e.code
        return [(n, None if (v := values.get(n)) is None else v if isinstance(v, str) else "; ".join(map(str, v)) if isinstance(v, list) else str(v)) for n in names], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("text", "identifiers", "descriptions", "known", "ask"))
            out = [answer(*row) if ask else (None, None) for *row, ask in zip(*columns, strict=True)]
            said = pa.array([x[0] for x in out], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, said, pa.array([x[1] for x in out], pa.string())], names=[*batch.schema.names, "said", "failure"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kept}, said map<string,string>, failure string")


def extract(pages: DataFrame, fields: list[Field], provider: Provider | None = None, threshold: float = 0.7, query: list[str] | None = None, carry: tuple[str, ...] = (), embeds: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html[, status_code, headers, cleaned, cached]) as rows (page_id, url, status, data, warnings, error, source), one for each page.

    Facts of the page come first; the provider is asked only where they leave more open than `threshold` allows or a field
    that a shop must say, and again with more text if too much of its answer is null. Values that are known stay. Block pages
    and failed calls are rows with an error, not exceptions. Null html is an empty page. Empty table: no rows. Columns named in
    `carry` go along. headers: response headers, facts like others. cleaned: a cached text of the page. cached: a map of values that the field cache has, which
    count for what the page's own facts leave open. embeds: see parsed(). A column `code` that is there already is an error that stays.
    """
    validate(fields)
    provider = provider or PatternProvider()
    query = query_terms(fields) if query is None else query
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    numeric = any(f.type in ("integer", "float") for f in fields)
    reason = escalation_reason(F.col("html"), status, numeric)
    code = F.when(reason.isin("block_signature", "block_content", "soft_status"), "FETCH_BLOCKED")
    code = F.coalesce(F.col("code"), code) if "code" in pages.columns else code
    extra = [c for c in ("headers", "cleaned") if c in pages.columns and c not in carry]
    held = ("cached",) if "cached" in pages.columns and "cached" not in carry else ()
    rows = pages.select("page_id", "url", "html", *carry, *extra, *held, code.alias("code"))
    rows = parsed(rows, fields, (*carry, *held), embeds)

    raw = {f.name: resolve(F.col("facts"), f) for f in fields}
    if held:
        raw = {n: F.coalesce(c, F.try_element_at("cached", F.lit(n))) for n, c in raw.items()}
    usable = [F.struct(F.lit(f.name).alias("k"), F.when(~failed(raw[f.name], f.type), raw[f.name]).alias("v")) for f in fields]
    known = F.map_from_entries(F.filter(F.array(*usable), lambda x: x["v"].isNotNull()))
    product = [f.name for f in fields if content.PRODUCT_FIELD.search(f.name)]
    rows = rows.withColumn("known", known).withColumn("have", F.size("known"))
    rows = rows.withColumn("ask", F.col("code").isNull() & ~skips_rest(F.col("have"), fields, F.filter(F.array(*[F.lit(f.name) for f in fields]), lambda n: ~F.map_contains_key(F.col("known"), n)), threshold))
    rows = asked(rows.drop("facts"), fields, provider, query)

    value = lambda said: {f.name: F.coalesce(F.try_element_at("known", F.lit(f.name)), F.try_element_at(said, F.lit(f.name))) for f in fields}
    first, notes = coerce_row(fields, value(F.col("said")))
    rows = rows.withColumn("first", first).withColumn("first_notes", notes).withColumn("first_said", F.col("said")).withColumn("first_failure", F.col("failure"))
    nulls = lambda of: sum((F.col(f"{of}.`{f.name}`").isNull().cast("int") for f in fields), F.lit(0))
    shop = F.exists(F.array(*[F.col(f"first.`{n}`").isNull() for n in product]), lambda x: x) if product else F.lit(False)
    fires = null_rate_fires(nulls("first"), F.lit(len(fields)), F.lit(bool(product)), shop, F.col("have") > 0)
    rows = rows.withColumn("ask", F.col("ask") & F.col("failure").isNull() & fires).drop("said", "failure")
    rows = asked(rows, fields, provider, query, second=True)
    second, more = coerce_row(fields, value(F.col("said")))
    rows = rows.withColumn("second", second).withColumn("second_notes", more)
    better = F.col("said").isNotNull() & (nulls("second") < nulls("first"))

    code = F.coalesce("code", "first_failure")
    good = code.isNull()
    source = F.when(F.col("have") == len(fields), "metadata").when(F.col("first_said").isNull(), "metadata_partial").when(better, "fallback").otherwise("provider")
    return rows.select(
        "page_id",
        "url",
        F.when(good, "success").otherwise("error").alias("status"),
        F.when(good, F.when(better, F.col("second")).otherwise(F.col("first"))).cast(row_type(fields)).alias("data"),
        F.when(good, F.when(better, F.col("second_notes")).otherwise(F.col("first_notes"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        error_row(code).alias("error"),
        F.when(good, source).alias("source"),
        *carry,
    )


def summary(results: DataFrame) -> DataFrame:
    """total, succeeded and failed of a batch."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"))
