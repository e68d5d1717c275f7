"""The page functions under names that SQL texts can use."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagelathe.functions import text, urls


def raw(pattern: str) -> str:
    """pattern as a SQL string that takes backslashes as they are."""
    quote = '"' if "'" in pattern else "'"
    return f"r{quote}{pattern}{quote}"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {raw(pattern)}, '{by}')"


def url_part(i: int) -> str:
    return f"regexp_extract(x, {raw(urls.SPLIT)}, {i})"


VISIBLE = f"trim({replaced(replaced(replaced(replaced('x', text.HIDDEN, ' '), text.COMMENT, ' '), '<[^>]+>', ' '), r'\s+', ' ')})"
PATH, QUERY = replaced(url_part(3), "/+$", ""), url_part(4)
#: Name, type and body of each function of one string, in terms of x.
SCALARS = (
    ("page_visible_text", "string", VISIBLE),
    ("page_digit_share", "double", f"coalesce(length({replaced(VISIBLE, '[^0-9]', '')}) / nullif(length({VISIBLE}), 0), 0.0d)"),
    ("page_host", "string", f"lower({replaced(replaced(url_part(2), '^.*@', ''), r':\d*$', '')})"),
    ("page_crawl_url", "string", f"concat(lower({url_part(1)}), '://', lower({url_part(2)}), if({PATH} = '', '/', {PATH}), if({QUERY} <> '', concat('?', {QUERY}), ''))"),
)


@udtf(returnType="ord int, line string")
class TextLines:
    """text_lines(text): the lines of a text that are not blank."""

    def eval(self, text: str):
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                yield i, line


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session: SQL functions, which Catalyst inlines, and the table function text_lines."""
    for name, kind, body in SCALARS:
        spark.sql(f"create or replace temporary function {name}(x string) returns {kind} return {body}")
    spark.udtf.register("text_lines", TextLines)
    return [n for n, _, _ in SCALARS] + ["text_lines"]
