"""Connected components of a link table, and what finds links inside large groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.llm.shared import KEY_ROWS, arrow_rows, bounded, discard, materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (a, b: long): component is the smallest node that it reaches.

    Alternating large-star and small-star steps: each round hangs every node's neighbours on the smallest one, which
    needs a grouped minimum (partial sums before the shuffle) and a join that adaptive execution may split. Every
    round's links are written to the shared folder, so lineage stays short; a round that changes nothing ends it.
    """
    spark = links.sparkSession
    now = materialize(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    for _ in range(rounds):
        # large star: neighbours above a node go to the smallest neighbour
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        after = materialize(small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        _drop(spark, now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _drop(spark, df: DataFrame) -> None:
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        discard(spark, path)


def block_pairs(members: DataFrame, key: list[str], order: str, block: int) -> DataFrame:
    """members dealt so that any two of the same key meet in one group of at most 2 * block rows.

    Adds g0, g1 (the pair of blocks) and `side`. A key of at most `block` members is one group; a larger one is cut
    into n / block blocks by a hash of `order`, and each pair of blocks is a group, so that a hot key spreads over
    (n / block)^2 / 2 tasks of equal size. Nothing is dropped.
    """
    sizes = members.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1")
    cuts = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    rows = members.join(sizes, key).withColumn("__k", cuts).drop("__n")
    rows = rows.withColumn("__mine", F.when(F.col("__k") > 1, F.pmod(F.xxhash64(F.lit(7), order), F.col("__k"))).otherwise(0).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    return rows.withColumns({"g0": F.least("__mine", "__other"), "g1": F.greatest("__mine", "__other"), "side": (F.col("__mine") > F.col("__other")).cast("int")}).drop("__k", "__mine", "__other")


def by_groups(rows: DataFrame, key: list[str], work: Callable[[pa.Table, list[int]], pa.RecordBatch | None], schema: str, n: int) -> DataFrame:
    """`work` on runs of rows of the same key: a table and where its groups begin and end, many small groups a call.

    Groups must be small (see block_pairs); a grouped-map function would start a call for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch]).combine_chunks()
            cut = _runs(table, key)
            if len(cut) > 2 and (got := work(table, cut[:-1])) is not None:
                yield got
            rest = table.slice(cut[-2], cut[-1] - cut[-2]).to_batches()
        if rest:
            table = pa.Table.from_batches(rest).combine_chunks()
            if (got := work(table, [0, table.num_rows])) is not None:
                yield got

    arrow_rows(rows.sparkSession, KEY_ROWS)
    return rows.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(bounded(run), schema)


def _runs(table: pa.Table, key: list[str]) -> list[int]:
    new = np.zeros(table.num_rows, bool)
    for k in key:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return [0, *np.flatnonzero(new).tolist(), table.num_rows]


#: `side` of a row in a group: a member, a member that every part of its group gets, and the first of those.
MEMBER, HUB, FIRST_HUB = 0, 1, 2
LINKS = "gid long, a long, b long"


def span_links(members: DataFrame, payload: DataFrame, work: Callable[[pa.Table, list[int]], pa.RecordBatch | None], block: int, n: int) -> DataFrame:
    """(a, b) links that connect what is linked within each group of members (gid, pid, weight: long); payload has a row for each pid.

    A group of at most `block` members is one call's. A larger one is dealt into parts, and each part gets up to eight hubs
    as well, the members of the largest weight, so that the group of one thing and its variants is joined together by its
    hubs in rows that grow with the group. Members that a part does not join to the first hub are few then; a second pass
    compares them with all parts, so no link is lost: two members are joined to the first hub both, or one of them is in
    that pass. `work` gets rows sorted by group with `side`, and returns links (gid, a, b); b is null for a member of
    a part with hubs that is not joined to the first one.
    """
    sizes = members.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1")
    rows = members.join(sizes, "gid").withColumn("k", F.ceil(F.col("m") / F.lit(block)).cast("int")).drop("m")
    rows = materialize(rows.withColumn("part", F.when(F.col("k") > 1, F.pmod(F.xxhash64(F.lit(7), "pid"), F.col("k"))).otherwise(0).cast("int")))
    dealt = rows.select("gid", "part", "pid", F.lit(MEMBER).alias("side"))
    large = rows.where("k > 1")
    if not large.isEmpty():
        best = large.groupBy("gid", "k", F.pmod(F.xxhash64(F.lit(5), "pid"), F.lit(8)).alias("salt")).agg(F.max(F.struct("weight", "pid")).alias("top"))
        best = best.withColumn("first", F.max("top").over(Window.partitionBy("gid")) == F.col("top"))
        hubs = best.select("gid", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.col("top.pid").alias("pid"), F.when(F.col("first"), FIRST_HUB).otherwise(HUB).alias("side"))
        dealt = dealt.unionByName(hubs)
    held = payload.withColumnRenamed("pid", "__p")
    found = materialize(by_groups(dealt.join(held, F.col("pid") == F.col("__p")).drop("__p"), ["gid", "part"], work, LINKS, n))
    links = found.where("b is not null").select("a", "b")
    apart = found.where("b is null").select("gid", F.col("a").alias("pid")).distinct()
    if apart.isEmpty():
        return links
    apart = materialize(apart)
    counts = apart.groupBy("gid").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("u"))
    of = rows.select("gid", "k").distinct().join(counts, "gid")
    left = apart.join(of, "gid").select("gid", F.pmod(F.xxhash64(F.lit(3), "pid"), F.col("u")).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), "pid", F.lit(HUB).alias("side"))
    right = rows.join(counts, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("mine"), "part", "pid", F.lit(MEMBER).alias("side"))
    again = left.unionByName(right).join(held, F.col("pid") == F.col("__p")).drop("__p")
    return links.unionByName(by_groups(again, ["gid", "mine", "part"], work, LINKS, n).select("a", "b"))


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int], np.ndarray]:
    """A spanning forest (i, j) of the links among n members, and each member's tree.

    Breadth first: near(x, rest) says which of `rest` link with x; who is reached leaves the rest, so there is one
    comparison row for each member and never a list of all pairs.
    """
    left: list[int] = []
    right: list[int] = []
    tree, rest = np.arange(n), np.arange(n)
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            x = queue.pop()
            ok = near(x, rest)
            if ok.any():
                got = rest[ok]
                left += [x] * len(got)
                right += got.tolist()
                queue += got.tolist()
                tree[got] = root
                rest = rest[~ok]
    return left, right, tree


def spanned(table: pa.Table, cut: list[int], near_of: Callable[[int, int], Callable[[int, np.ndarray], np.ndarray]], small: Callable[[list[tuple[int, int]]], tuple[np.ndarray, np.ndarray]] | None = None) -> pa.RecordBatch | None:
    """The rows that span_links() wants of its `work`: near_of(a, b) gives `near` of forest() for the rows a to b."""
    gid, pid, side = (table.column(c).to_numpy() for c in ("gid", "pid", "side"))
    hubs = np.add.reduceat(side == FIRST_HUB, cut[:-1]) > 0
    plain = [(a, b) for a, b, h in zip(cut, cut[1:], hubs.tolist(), strict=False) if b - a > 1 and not h]
    rest = [(a, b) for a, b, h in zip(cut, cut[1:], hubs.tolist(), strict=False) if b - a > 1 and h]
    i, j, lone = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if small and plain:
        x, y = small(plain)
        i.append(x)
        j.append(y)
        plain = []
    for a, b in plain + rest:
        x, y, tree = forest(b - a, near_of(a, b))
        i.append(a + np.array(x, np.int64))
        j.append(a + np.array(y, np.int64))
        first = np.flatnonzero(side[a:b] == FIRST_HUB)
        if len(first):
            lone.append(a + np.flatnonzero((tree != tree[first[0]]) & (side[a:b] == MEMBER)))
    i, j, lone = np.concatenate(i), np.concatenate(j), np.concatenate(lone)
    if not len(i) and not len(lone):
        return None
    ids = [np.concatenate([gid[i], gid[lone]]), np.concatenate([pid[i], pid[lone]])]
    to = pa.array(np.concatenate([pid[j], np.zeros(len(lone), np.int64)]), mask=np.concatenate([np.zeros(len(i), bool), np.ones(len(lone), bool)]))
    return pa.RecordBatch.from_arrays([pa.array(ids[0]), pa.array(ids[1]), to], names=["gid", "a", "b"])
