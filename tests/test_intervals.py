"""Joins on overlapping times, and release times, against loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import crawl, intervals

START = datetime.datetime(2024, 1, 1)


def moment(seconds):
    return START + datetime.timedelta(seconds=seconds)


def made(n, seed, hot=0.5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.choice([rng.uniform(0, 50_000), rng.randint(0, 800) * 60])
        length = rng.choice([0, 1, 59.999999, 60, 60.000001, 240, 3600, rng.uniform(0, 900), 10**7])
        rows.append(("hot" if rng.random() < hot else rng.choice("abc"), i, moment(a), moment(a + length)))
    return rows + [(None, -1, moment(0), moment(9)), ("hot", -2, None, moment(9)), ("hot", -3, moment(9), None), ("hot", -4, moment(99), moment(9)), rows[0]]


@pytest.mark.parametrize("width", ["1 minute", "1 second", "2 days"])
def test_overlaps(spark, width):
    left, right = made(150, 1), made(130, 2)
    a = spark.createDataFrame(left, "k string, i int, a timestamp, z timestamp")
    b = spark.createDataFrame(right, "k string, j int, b timestamp, y timestamp")
    pairs = intervals.overlapping(a, b, ["k"], ("a", "z"), ("b", "y"), width)
    got = sorted((r["i"], r["j"]) for r in pairs.collect())
    ok = lambda r: None not in r and r[2] <= r[3]
    want = sorted((x[1], y[1]) for x in left for y in right if ok(x) and ok(y) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want and pairs.columns == ["k", "i", "a", "z", "j", "b", "y"]


def test_no_loop_in_the_plan(spark):
    a = spark.createDataFrame(made(20, 1), "k string, i int, a timestamp, z timestamp")
    b = spark.createDataFrame(made(20, 2), "k string, j int, b timestamp, y timestamp")
    plan = intervals.overlapping(a, b, ["k"], ("a", "z"), ("b", "y"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "__bin" in plan
    with pytest.raises(ValueError):
        intervals.overlapping(a, a, ["k"], ("a", "z"), ("a", "z"))
    assert intervals.overlapping(a.limit(0), b, ["k"], ("a", "z"), ("b", "y")).count() == 0 == intervals.overlapping(a.limit(0), b.limit(0), ["k"], ("a", "z"), ("b", "y")).count()


def test_versions_that_hold(spark):
    entries = spark.createDataFrame([("u", 1, moment(0), moment(100)), ("u", 2, moment(50), moment(60)), ("u", 3, moment(200), None)], "url string, version int, since timestamp, until timestamp")
    moments = spark.createDataFrame([("u", 10, moment(55)), ("u", 11, moment(60)), ("u", 12, moment(100)), ("u", 13, moment(10**7)), ("v", 14, moment(1)), (None, 15, moment(1)), ("u", 16, None)], "url string, id int, at timestamp")
    got = {r["id"]: r["version"] for r in intervals.valid_at(moments, entries, ["url"], "at", "since", "until", "version").collect()}
    assert got == {10: 2, 11: 1, 12: None, 13: 3, 14: None, 15: None, 16: None}


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_release_times_are_those_of_a_queue(spark, buckets):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), i, moment(rng.choice([0, 5, 5, 20]) + rng.randint(0, 30)), rng.choice([None, 0, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "host string, id long, ts timestamp, streak int")
    got = {r["id"]: (r["gap_ms"], r["ms"]) for r in crawl.release_times(df, 250, 750, buckets).withColumn("ms", F.unix_millis("release")).collect()}
    assert len(got) == len(rows) and all(250 <= got[i][0] / (2 if (s or 0) >= 2 else 1) < 750 for _, i, _, s in rows)
    last = {}
    for h, i, t, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        at = int(t.timestamp() * 1000)
        last[h] = max(at, last[h] + got[i][0]) if h in last else at
        assert got[i][1] == last[h]
