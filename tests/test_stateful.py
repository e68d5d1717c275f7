"""Stateful streams against what a table of all rows says, over restarts."""

import datetime
import random

import pytest

from pagelathe.streaming import store

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, store.ROCKSDB)
    yield
    spark.conf.unset(name)


def streamed(spark, tmp_path, make, lots, schema):
    """All rows that a stream puts out for lots of rows, a file and a start of the query for each."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(source)
        q = make(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(300)
    return spark.read.parquet(out)


def at(s):
    return START + datetime.timedelta(seconds=s)


def test_a_store_expires_and_survives_restarts(spark, tmp_path):
    rng = random.Random(1)
    ops, n = [], 0
    for lot in range(3):
        rows = []
        for _ in range(60):
            op = rng.choice(["set", "set", "get", "get", "exists", "delete"])
            rows.append((rng.choice("abcd"), n, at(lot * 1000 + rng.randint(0, 900)), op, f"v{n}" if op == "set" else None, rng.choice([None, 0, 5, 300, 5000]) if op == "set" else None))
            n += 1
        ops.append(rows)
    ops.append([("a", 9000, at(100_000), "get", None, None)])
    schema = "key string, id long, ts timestamp, op string, value string, ex long"
    got = streamed(spark, tmp_path, store.keyed_store, ops, schema)
    want = store.replayed(spark.createDataFrame([r for lot in ops for r in lot], schema))
    key = lambda r: r["id"]
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]
    found = [r["found"] for r in want.collect()]
    assert any(found) and not all(found)


def test_urls_are_let_go_at_a_polite_pace(spark, tmp_path):
    rows = [("h", i, at(i * 0.1), f"/{i}", None) for i in range(4)] + [("g", 50, at(0.2), "/g", None)]
    refused = [("h", 10 + i, at(10), None, 429) for i in range(2)]
    later = [("h", 20 + i, at(12), f"/{20 + i}", None) for i in range(3)]
    schema = "host string, id long, ts timestamp, url string, status int"
    lots = [rows, refused, later, [("z", 99, at(100), "/z", None)], [("z", 100, at(200), "/y", None)]]
    got = {r["id"]: (r["host"], r["url"], (r["release"] - START).total_seconds()) for r in streamed(spark, tmp_path, store.released, lots, schema).collect()}
    want = {0: ("h", "/0", 0.0), 1: ("h", "/1", 0.5), 2: ("h", "/2", 1.0), 3: ("h", "/3", 1.5), 50: ("g", "/g", 0.2), 20: ("h", "/20", 12.0), 21: ("h", "/21", 13.0), 22: ("h", "/22", 14.0), 99: ("z", "/z", 100.0)}
    assert {k: v for k, v in got.items() if k != 100} == want


def test_pages_meet_their_snapshots_or_come_alone(spark, tmp_path):
    schema = "page_id long, ts timestamp, html string"
    # after a restart a watermark moves on once both sides have new rows
    snaps = iter([[(1, at(60), "snap 1"), (2, at(1000), "too late"), (4, at(5), "no page")], [(90, at(6000), "x")], [(91, at(12_000), "x")]])
    lots = [[(1, at(0), "p1"), (2, at(0), "p2"), (3, at(30), "p3")], [(9, at(5000), "later")], [(9, at(9000), "last")]]

    def make(pages):
        spark.createDataFrame(next(snaps), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
        return store.rendered(pages, spark.readStream.schema(schema).parquet(str(tmp_path / "b")))

    got = {(r["page_id"], r["html"]): r["rendered"] for r in streamed(spark, tmp_path, make, lots, schema).collect()}
    assert {k: v for k, v in got.items() if k[0] < 9} == {(1, "p1"): "snap 1", (2, "p2"): None, (3, "p3"): None}


def test_sessions_end_behind_the_watermark(spark, tmp_path):
    schema = "user_id long, ts timestamp"
    lots = [[(1, at(0)), (1, at(50)), (2, at(10))], [(1, at(110)), (2, at(200))], [(3, at(10_000))], [(3, at(20_000))]]
    got = sorted((r["user_id"], (r["start"] - START).total_seconds(), (r["end"] - START).total_seconds(), r["n"]) for r in streamed(spark, tmp_path, lambda s: store.sessions(s, "60 seconds"), lots, schema).collect())
    assert [r for r in got if r[0] < 3] == [(1, 0.0, 170.0, 3), (2, 10.0, 70.0, 1), (2, 200.0, 260.0, 1)]
