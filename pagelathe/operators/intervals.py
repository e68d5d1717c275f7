"""Joins on overlapping times: which entry of a key was valid when, without comparing all entries of a key.

An interval is filed under bins. Bins come in levels, each FACTOR times as wide as the one below, and an interval's own level is the first whose bins
are at least as wide as it is: there it lies in two bins at most. Two intervals overlap only if they share a bin on the higher of their
own levels, so each side is filed on its own level and on those above that the other side uses, and the join is an equi-join on key, level
and bin. A hot key is dealt over its bins, and a long interval is filed as seldom as a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level's bins are so many times as wide as those below; levels.
FACTOR, LEVELS = 4, 24


def _level(length: Column, width: int) -> Column:
    """The first level whose bins are at least as wide as `length` (microseconds)."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(FACTOR), F.greatest(length, F.lit(1)) / F.lit(float(width)))).cast("int"))


def _checked(level: Column, length: Column, width: int) -> Column:
    """`level`, or the next one if rounding of the logarithm made it too small."""
    wide = F.lit(width) * F.pow(F.lit(float(FACTOR)), level)
    return F.least(F.when(wide < length, level + 1).otherwise(level), F.lit(LEVELS)).cast("int")


def _filed(rows: DataFrame, begin: str, end: str, width: int, levels: list[int], prefix: str) -> DataFrame:
    """A row for each level in use, from its own one up, and each bin that the interval touches there: two at most."""
    a, z = (F.unix_micros(F.col(c).cast("timestamp")) for c in (begin, end))
    length = F.col(f"{prefix}z") - F.col(f"{prefix}a")
    rows = rows.withColumns({f"{prefix}a": a, f"{prefix}z": z}).where(length >= 0)
    rows = rows.withColumn(f"{prefix}own", _checked(_level(length, width), length, width))
    rows = rows.withColumn("__level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(f"{prefix}own")))) if levels else rows.withColumn("__level", F.lit(None).cast("int")).where(F.lit(False))
    wide = (F.lit(width) * F.pow(F.lit(float(FACTOR)), F.col("__level"))).cast("long")
    at = lambda c: F.floor(F.col(c) / wide).cast("long")
    return rows.withColumn("__bin", F.explode(F.sequence(at(f"{prefix}a"), at(f"{prefix}z"))))


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def _seconds(width: str) -> float:
    number, unit = width.split()
    return float(number) * _UNITS[unit.removesuffix("s")]


def _levels(rows: DataFrame, begin: str, end: str, width: int) -> set[int]:
    a, z = (F.unix_micros(F.col(c).cast("timestamp")) for c in (begin, end))
    found = rows.select((z - a).alias("n")).where("n >= 0").select(_checked(_level(F.col("n"), width), F.col("n"), width).alias("k")).distinct()
    return {r["k"] for r in found.collect()}  # LEVELS + 1 at most


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str], other: tuple[str, str], width: str = "1 minute") -> DataFrame:
    """Pairs of rows of equal keys whose closed intervals share a moment: left's columns, then right's without the keys.

    span and other name the columns (timestamps) of the first and last moment; for a moment name one column twice. width is about the
    length of a short interval. Rows with a null key or moment, or that end before they begin, meet nothing. Repeated rows meet as often as they come. A
    column of both sides, but for the keys, has to be renamed first: ValueError.
    """
    both = (set(left.columns) & set(right.columns)) - set(keys)
    if both:
        raise ValueError(f"columns of both sides: {sorted(both)}")
    micros = int(_seconds(width) * 1_000_000)
    levels = sorted(_levels(left, *span, micros) | _levels(right, *other, micros))
    a, b = _filed(left, *span, micros, levels, "__l"), _filed(right, *other, micros, levels, "__r")
    pairs = a.join(b, [*keys, "__level", "__bin"])
    # once: on the higher of both own levels, in the bin where the later one begins
    start = F.greatest("__la", "__ra")
    wide = (F.lit(micros) * F.pow(F.lit(float(FACTOR)), F.col("__level"))).cast("long")
    pairs = pairs.where((F.col("__level") == F.greatest("__lown", "__rown")) & (F.col("__bin") == F.floor(start / wide)) & (F.col("__la") <= F.col("__rz")) & (F.col("__ra") <= F.col("__lz")))
    return pairs.select(*left.columns, *[c for c in right.columns if c not in keys])


def valid_at(moments: DataFrame, entries: DataFrame, keys: list[str], at: str, since: str, until: str, version: str, width: str = "1 minute") -> DataFrame:
    """moments with the columns of the entry that was valid then (since <= at < until), of several the one of the largest `version`; nulls for none.

    An entry without `until` holds for ever. Null keys or moments: no entry. moments must not repeat a row: each comes back once.
    """
    far = F.make_timestamp_ntz(F.lit(9999), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp")
    last = F.coalesce(F.col(until).cast("timestamp"), far) - F.expr("interval 1 microsecond")
    held = entries.withColumn("__until", last)
    pairs = overlapping(moments, held, keys, (at, at), (since, "__until"), width).drop("__until")
    names = [c for c in entries.columns if c not in keys]
    keyed = [F.col(c).alias(f"__m{i}") for i, c in enumerate(moments.columns)]
    best = pairs.groupBy(*keyed).agg(F.max_by(F.struct(*names), version).alias("__best"))
    cond = F.lit(True)
    for i, c in enumerate(moments.columns):
        cond &= F.col(c).eqNullSafe(F.col(f"__m{i}"))
    return moments.join(best, cond, "left").select(*moments.columns, *[F.col(f"__best.{n}").alias(n) for n in names])
