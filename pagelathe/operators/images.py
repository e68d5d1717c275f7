"""Image candidates of a page, ranked by what they may say of missing fields."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.functions.text import letter_tokens
from pagelathe.functions.urls import host, is_tracker, part, resolve

#: Classes and file names of pictures that decorate (fixed patterns).
DECORATIVE_CLASS = r"(?i)\b(avatar|icon|logo|banner|bg|background|badge|emoji|spacer|pixel|placeholder|spinner|loading|ad|advertisement|social|share|button|thumbnail-xs|thumbnail-sm)\b"
DECORATIVE_FILE = r"(?i)(pixel|spacer|blank|tracking|beacon|transparent|1x1|logo|favicon|sprite|icon|arrow|chevron|close|menu|hamburger|star|rating-)\."


class Pictures(HTMLParser):
    """All img and source tags: (src, alt, class, width, height), captions of figures added to alt."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.figure: int | None = None
        self.caption = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        first = a.get("srcset", "").split(",")[0].split()
        size = lambda k: int(a[k]) if a.get(k, "").isdigit() else 0
        if tag == "figure":
            self.figure = len(self.found)
        elif tag == "figcaption":
            self.caption = True
        elif tag == "img":
            src = a.get("src") or a.get("data-src") or a.get("data-lazy-src") or (first[0] if first else "")
            self.found.append([src, a.get("alt", ""), a.get("class", ""), size("width"), size("height")])
        elif tag == "source" and first:
            self.found.append([first[0], "", "", 0, 0])

    def handle_endtag(self, tag: str) -> None:
        if tag == "figure":
            self.figure = None
        elif tag == "figcaption":
            self.caption = False

    def handle_data(self, data: str) -> None:
        if self.caption and self.figure is not None and data.strip():
            for row in self.found[self.figure :]:
                row[1] = f"{row[1]} {' '.join(data.split())}"


def pictures(pages: DataFrame) -> DataFrame:
    """(page_id, url, ord, src, alt, class, w, h) of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                parser = Pictures()
                parser.feed(h or "")
                parser.close()
                rows += [(p, u, i, *x) for i, x in enumerate(parser.found)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "ord", "src", "alt", "class", "w", "h"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, ord int, src string, alt string, class string, w int, h int")


def image_score(alt: Column, stem: Column, fields: Column, same_origin: Column) -> Column:
    """Words that alt text and file name share with the fields' names; half as much again from the page's own host."""
    shared = F.size(F.array_intersect(letter_tokens(F.concat_ws(" ", alt, stem)), letter_tokens(fields)))
    return shared * F.when(same_origin, 1.5).otherwise(1.0)


def candidates(found: DataFrame, missing: list[str] | Column, most: int = 3) -> DataFrame:
    """(page_id, image, alt, score, area, place): the best `most` of each page, by the names of missing fields: the same for all, or a column of found."""
    found = found.withColumn("__missing", missing if isinstance(missing, Column) else F.lit(" ".join(missing)))
    rows = found.where((F.col("src") != "") & ~F.col("src").startswith("data:") & ~F.col("class").rlike(DECORATIVE_CLASS)).withColumn("image", resolve(F.col("url"), F.col("src")))
    file = F.regexp_extract(F.regexp_replace(part(F.col("image"), 3), "/+$", ""), r"([^/]*)$", 1)
    tiny = F.col("w").between(1, 149) & F.col("h").between(1, 149)
    rows = rows.where(~is_tracker(F.col("image")) & ~file.rlike(DECORATIVE_FILE) & ~tiny)
    rows = rows.groupBy("page_id", "image").agg(F.min_by(F.struct("url", "alt", "w", "h", "ord", "__missing"), "ord").alias("x")).select("page_id", "image", "x.*")
    file = F.regexp_extract(F.regexp_replace(part(F.col("image"), 3), "/+$", ""), r"([^/]*)$", 1)
    score = image_score(F.col("alt"), F.regexp_replace(file, r"\.[^.]+$", ""), F.col("__missing"), host(F.col("image")) == host(F.col("url")))
    side = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(300)
    rows = rows.withColumns({"score": score, "area": side("w") * side("h")})
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), F.desc("area"), "ord")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("page_id", "image", "alt", "score", "area", "place")
