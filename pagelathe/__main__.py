"""python -m pagelathe extract|batch|crawl: tables of pages in, rows as JSON out."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from pagelathe.plans import engine, service
from pagelathe.sources import tables


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagelathe", description=__doc__)
    parser.add_argument("command", choices=("extract", "batch", "crawl"))
    parser.add_argument("--pages", required=True, help="Parquet table (page_id, url, html)")
    parser.add_argument("--schema", required=True, help="a JSON list of fields, or a file of one")
    parser.add_argument("--urls", help="batch: a text file of URLs; crawl: the seeds")
    parser.add_argument("--links", help="crawl: Parquet table (src, dst, ord)")
    parser.add_argument("--depth", type=int, default=2)
    parser.add_argument("--max-pages", type=int)
    parser.add_argument("--follow", help="crawl: a pattern that URLs must match")
    parser.add_argument("--fail-fast", action="store_true")
    parser.add_argument("--output", help="a folder for JSON lines; else they are printed")
    a = parser.parse_args(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("pagelathe").getOrCreate()
    pages = spark.read.parquet(a.pages)
    fields = tables.schema(a.schema if a.schema.lstrip().startswith("[") else Path(a.schema).read_text())
    if a.command == "extract":
        rows = engine.extract(pages, fields)
    elif not a.urls or a.command == "crawl" and not a.links:
        parser.error("batch needs --urls, crawl --urls and --links")
    elif a.command == "batch":
        rows = service.batch(tables.urls(spark, a.urls).withColumnRenamed("ord", "ordinal"), pages, fields, fail_fast=a.fail_fast).orderBy("ordinal")
    else:
        rows, counters = service.crawl_pages(pages, spark.read.parquet(a.links), tables.urls(spark, a.urls).select("url"), fields, max_depth=a.depth, max_pages=a.max_pages, glob=a.follow)
        print(counters.first().asDict(), file=sys.stderr)
    if a.output:
        tables.write_json(rows, a.output)
    else:
        for line in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            print(line["j"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
