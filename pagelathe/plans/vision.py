"""A third pass: fields that text left null are asked of the page's best pictures."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.functions.coerce import Field, coerce_row, row_type, validate
from pagelathe.operators import images
from pagelathe.plans.provider import Request, output_budget, parsed, prompt
from pagelathe.sources.tables import IMAGE_BYTES, image_bytes

#: Pictures of a page that are looked at, and their bytes together.
PICTURES, PAGE_BYTES = 3, 2 * IMAGE_BYTES


class Seer(Protocol):
    def see(self, request: Request, pictures: list[tuple[bytes, str]]) -> dict[str, object] | str:
        """Raw values of the request's fields from pictures (bytes, type). Called again if a task is: it must have no effects."""


def pictures_of(pages: DataFrame, files: DataFrame, most: int = PICTURES, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(page_id, pictures: array of place, mime and bytes) of pages (page_id, url, html, missing: array of field names): the best ones by what is missing.

    Of the best `most` candidates those come whose bytes files (url, mime, bytes) have, in order, as long as all of a page together have `page_bytes` at most.
    """
    wanted = pages.select(F.col("page_id").alias("__page"), F.array_join("missing", " ").alias("missing"))
    found = images.pictures(pages).join(wanted, F.col("page_id") == F.col("__page")).drop("__page")
    held = image_bytes(images.candidates(found, F.col("missing"), most), files)
    before = Window.partitionBy("page_id").orderBy("place")
    held = held.withColumn("__sum", F.sum(F.octet_length("bytes")).over(before)).where(F.col("__sum") <= page_bytes)
    return held.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "mime", "bytes"))).alias("pictures"))


def filled(results: DataFrame, pages: DataFrame, files: DataFrame, fields: list[Field], seer: Seer, key: str = "page_id", text: str | None = None) -> DataFrame:
    """results (key, status, data, warnings and others) with nulls of `data` filled from pictures of pages (key, url, html[, text]), bytes in files (url, mime, bytes).

    Only good rows with a null, whose pages have pictures with bytes, are asked, once each and for their null fields only; what is there stays. A failed call leaves its row
    as it is. key: a long that names a row in both tables; null keys, repeated keys of pages: the row is left, and one of the pages counts. Empty tables: nothing is asked.
    """
    validate(fields)
    names = [f.name for f in fields]
    null = F.filter(F.array(*[F.when(F.col(f"data.`{n}`").isNull(), F.lit(n)) for n in names]), lambda n: n.isNotNull())
    lacking = results.where("status = 'success' and data is not null").select(F.col(key).alias("__key"), null.alias("missing")).where("size(missing) > 0 and __key is not null").dropDuplicates(["__key"])
    shown = pages.select(F.col(key).cast("long").alias("page_id"), "url", "html", (F.col(text) if text else F.lit("")).alias("text")).dropDuplicates(["page_id"])
    shown = shown.join(lacking, F.col("page_id") == F.col("__key")).drop("__key")
    rows = shown.select("page_id", "text", "missing").join(pictures_of(shown.select("page_id", "url", "html", "missing"), files), "page_id")
    by_name = {f.name: f for f in fields}

    def answer(said: str | None, missing: list[str], pictures: list[dict]) -> list[tuple[str, str | None]] | None:
        asked = [by_name[n] for n in missing]
        try:
            values = parsed(seer.see(Request(said or "", prompt(asked, said or ""), tuple(asked), output_budget(asked)), [(p["bytes"], p["mime"]) for p in pictures]))
        except Exception:  # noqa: BLE001  pictures only add: without them the row stays as it is
            return None
        write = lambda v: None if v is None else v if isinstance(v, str) else "; ".join(map(str, v)) if isinstance(v, list) else str(v)
        return [(n, write(values.get(n))) for n in missing]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                got = answer(row["text"], row["missing"], row["pictures"])
                yield pa.RecordBatch.from_arrays([pa.array([row["page_id"]], pa.int64()), pa.array([got], pa.map_(pa.string(), pa.string())), pa.array([len(row["pictures"])], pa.int32())], names=["__key", "__seen", "__n"])

    seen = rows.mapInArrow(run, "__key long, __seen map<string,string>, __n int")
    out = results.join(seen, F.col(key) == F.col("__key"), "left")
    new, notes = coerce_row(fields, {n: F.try_element_at("__seen", F.lit(n)) for n in names})
    data = F.struct(*[F.coalesce(F.col(f"data.`{n}`"), new[n]).alias(n) for n in names]).cast(row_type(fields))
    more = F.when(F.col("__seen").isNotNull(), F.concat("warnings", notes)).otherwise(F.col("warnings"))
    kept = {"data": F.when(F.col("data").isNotNull(), data), "warnings": more}
    return out.select(*[kept.get(c, F.col(f"`{c}`")).alias(c) for c in results.columns], F.coalesce("__n", F.lit(0)).alias("pictures"))
