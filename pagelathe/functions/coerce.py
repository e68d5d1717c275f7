"""Casts of page text to declared types: null on failure, never an exception."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelathe.functions.text import clean_string, hide_credential, is_null_word

#: Declared types and the Spark types of their columns.
TYPES = {
    "string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "string",
    "array<string>": "array<string>", "array<integer>": "array<bigint>", "array<float>": "array<double>",
}
TRUE_WORDS = ("true", "yes", "1", "y", "on", "✓", "✔", "✅")
FALSE_WORDS = ("false", "no", "0", "n", "off", "✗", "✘", "❌")
DURATION = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


@dataclass(frozen=True)
class Field:
    """A declared column: its name and type, an example value and a hint for the extractor."""

    name: str
    type: str
    example: object = None
    hint: str | None = None


class SchemaInvalid(ValueError):
    """The declared fields cannot be a schema."""


def validate(fields: list[Field]) -> list[Field]:
    """fields, if there is one at least, names are unique and not blank, types are known and sizes in bounds."""
    if not 1 <= len(fields) <= 200:
        raise SchemaInvalid("a schema has 1 to 200 fields")
    seen: set[str] = set()
    for f in fields:
        if not f.name.strip() or len(f.name) > 200:
            raise SchemaInvalid("a field needs a name of 1 to 200 characters")
        if f.name in seen:
            raise SchemaInvalid(f"the field {f.name} is there twice")
        if f.type not in TYPES:
            raise SchemaInvalid(f"{f.type} is not a type")
        if f.hint and len(f.hint) > 1000:
            raise SchemaInvalid("a hint has at most 1000 characters")
        seen.add(f.name)
    return fields


def row_type(fields: list[Field]) -> str:
    """The struct of a result row, for from_json and for typed nulls."""
    return "struct<" + ",".join(f"`{f.name}`:{TYPES[f.type]}" for f in validate(fields)) + ">"


def to_string(c: Column) -> Column:
    return clean_string(hide_credential(c))


def duration_minutes(c: Column) -> Column:
    """Minutes of an ISO duration of days and time; seconds round half to even; null if it is none."""
    s = F.trim(c)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, DURATION, i), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))
    seconds = F.coalesce(F.nullif(F.regexp_extract(s, DURATION, 4), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(s.rlike(DURATION), part(1) * 1440 + part(2) * 60 + part(3) + F.rint(seconds / 60).cast("bigint"))


def to_integer(c: Column) -> Column:
    """Minutes if it reads like a duration and is one, else the first run of digits and commas."""
    s = F.trim(c)
    first = F.regexp_replace(F.regexp_extract(s, r"-?\d[\d,]*", 0), ",", "").try_cast("bigint")
    like = s.startswith("P") & (F.substring(s, 1, 3).contains("T") | F.substring(s, 2, 1).rlike("^[0-9]$"))
    return F.when(like, F.coalesce(duration_minutes(s), first)).otherwise(first)


def to_float(c: Column) -> Column:
    """With K, M, B or T as a factor, else what is left of digits, points and minus signs if that is a number."""
    s = F.trim(F.regexp_replace(F.trim(c), "[$£€¥]", ""))
    short = r"^(-?[\d,]+\.?\d*)\s*([kKmMbBtT])$"
    factor = F.element_at(F.create_map(*[F.lit(x) for k, v in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)) for x in (k, v)]), F.upper(F.regexp_extract(s, short, 2)))
    plain = F.regexp_replace(s, r"[^\d.\-]", "")
    number = F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
    return F.when(s.rlike(short), F.regexp_replace(F.regexp_extract(s, short, 1), ",", "").try_cast("double") * factor).otherwise(number)


def to_boolean(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def to_date(c: Column, today: str = "2024-01-01", day_first: bool = False) -> Column:
    """A date as ISO text. An ISO prefix stands as it is; else the first of these forms that is a day of the calendar, times of day and zones put aside:

    year, month and day as numbers (2024/12/20, 2024.12.20, 20241220); two numbers and a year of two or four digits (12/20/2024, 20.12.24), the first
    one a month unless it cannot be one or `day_first` is set; a month's name with a day, a year or both, in any order, weekdays and other words
    aside. A year of two digits is the one within 50 years of `today`; parts that lack come from `today`, its day cut to the month's last.
    Over 256 characters, or no such form: null.
    """
    text = F.struct(F.trim(c).alias("s"), _dates_only(F.lower(F.trim(c))).alias("low"))
    # one element, so that the text is made once however often it is looked at
    return F.transform(F.array(text), lambda t: _first_date(t["s"], t["low"], today, day_first))[0]


def _dates_only(low: Column) -> Column:
    """Without times of day and zones."""
    low = F.regexp_replace(low, r"\b\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]\.?m\b\.?)?(?:\s*(?:z|utc|gmt|[a-z]{3,4})?\s*[+-]\d{2}:?\d{2})?", " ")
    return F.regexp_replace(low, r"\b\d{1,2}\s*[ap]\.?m\b\.?", " ")


def _first_date(s: Column, low: Column, today: str, day_first: bool) -> Column:
    year_now = int(today[:4])

    def full_year(y: Column) -> Column:
        n = y.cast("int")
        near = F.lit(year_now // 100 * 100) + n
        return F.when(F.length(y) > 2, n).when(near >= year_now + 50, near - 100).when(near < year_now - 50, near + 100).otherwise(near)

    def day(y: Column, m: Column, d: Column) -> Column:
        text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        ok = y.isNotNull() & m.isNotNull() & d.isNotNull() & y.between(1, 9999)
        return F.date_format(F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))), "yyyy-MM-dd")

    def group(pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(low, pattern, k), F.lit(""))

    ymd = r"(?<![\d/.-])(\d{4})([/.-])(\d{1,2})\2(\d{1,2})(?!\d)"
    packed = r"(?<!\d)((?:19|20)\d{2})(\d{2})(\d{2})(?!\d)"
    two = r"(?<![\d/.-])(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})(?!\d)"
    a, b = group(two, 1).cast("int"), group(two, 3).cast("int")
    swap = (a > 12) | (F.lit(day_first) & (b <= 12))
    numbers = day(full_year(group(two, 4)), F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b))

    named = rf"\b({'|'.join(MONTHS)})(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, named, 1)).cast("int")
    year = full_year(F.coalesce(group(r"(?<!\d)(\d{4})(?!\d)", 1), group(r"['’](\d{2})(?!\d)", 1), group(rf"\d{{1,2}}(?:st|nd|rd|th)?[\s.-]+(?:of\s+)?(?:{'|'.join(MONTHS)})[a-z]*\.?[\s,.-]+(\d{{2}})(?!\d)", 1)))
    number = group(r"(?:^|[^0-9'’])(\d{1,2})(?:st|nd|rd|th)?(?:[^0-9]|$)", 1).cast("int")
    y = F.coalesce(year, F.lit(year_now))
    last = F.day(F.last_day(F.try_to_timestamp(F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01")), F.lit("yyyy-MM-dd"))))
    spelled = F.when(month > 0, day(y, month, F.coalesce(number, F.least(F.lit(int(today[8:10])), last))))

    any_form = F.coalesce(day(group(ymd, 1).cast("int"), group(ymd, 3).cast("int"), group(ymd, 4).cast("int")), numbers, spelled, day(group(packed, 1).cast("int"), group(packed, 2).cast("int"), group(packed, 3).cast("int")))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10)).when(F.length(s) <= 256, any_form)


def split_array(c: Column) -> Column:
    parts = F.transform(F.split(c, r"[,;|]|\s·\s|\s•\s"), lambda y: F.trim(y))
    return F.filter(parts, lambda x: x != "")


def to_array(c: Column, item: str) -> Column:
    """All items cast; null if one that is not a null word fails, or if there is none."""
    parts = split_array(c)
    cast = F.transform(parts, lambda x: F.struct(F.when(~is_null_word(x), SCALARS[item](x)).alias("v"), is_null_word(x).alias("n")))
    bad = F.exists(cast, lambda x: x["v"].isNull() & ~x["n"]) if item != "string" else F.lit(False)
    return F.when((F.size(parts) > 0) & ~bad, F.transform(cast, lambda x: x["v"]))


SCALARS = {"string": to_string, "integer": to_integer, "float": to_float, "boolean": to_boolean, "date": to_date}


def coerce(c: Column, declared: str) -> Column:
    """c as the declared type; null words are null."""
    value = to_array(c, declared[6:-1]) if declared.startswith("array<") else SCALARS[declared](c)
    return F.when(~is_null_word(c), value)


def failed(c: Column, declared: str) -> Column:
    """Whether c is there but is not of the declared type. Blank after cleaning and hidden keys are no failures."""
    if declared == "string":
        return F.lit(False)
    return c.isNotNull() & ~is_null_word(c) & coerce(c, declared).isNull()


def coerce_row(fields: list[Field], raw: dict[str, Column]) -> tuple[Column, Column]:
    """(data: a struct of typed values, warnings: one text for each value that could not be cast)."""
    data = F.struct(*[coerce(raw[f.name], f.type).alias(f.name) for f in fields])
    shown = lambda c: F.when(F.length(c) > 78, F.concat(F.lit("'"), F.substring(c, 1, 76), F.lit("..."))).otherwise(F.concat(F.lit("'"), c, F.lit("'")))
    notes = [F.when(failed(raw[f.name], f.type), F.concat(F.lit(f"{f.name}: could not coerce "), shown(raw[f.name]), F.lit(f" to {f.type}"))) for f in fields]
    return data, F.filter(F.array(*notes), lambda x: x.isNotNull())
