"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.llm.shared import materialize, prefix_sum, rows_per_partition, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...], n: int) -> DataFrame:
    """sizes (source, source_size) with `target`: `share` of all words by weight, at most `most` times a source's size.

    Water-filling in closed form: sources come by the level (capacity / weight) at which they are full; the first k
    are full exactly when the level left for the others is not below theirs, so running sums find all targets.
    Sources come by code point, null last. They may be as many as hosts: both orders are range-sorted over tasks.
    """
    last = F.col("source").isNull()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    one = running(sizes, [last, F.col("source")], {"__rank": F.lit(1)}, n).withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    one = materialize(one.withColumn("level", F.col("most") / F.col("weight")).drop("__part"))
    words, heavy = one.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = float(words or 0) * share
    by_level = running(one, [F.col("level"), last, F.col("source")], {"__full": F.col("most"), "__weight": F.col("weight")}, n)
    fair = F.greatest(F.lit(budget) - F.col("__full"), F.lit(0.0)) / (F.lit(heavy) - F.col("__weight"))
    by_level = materialize(by_level.withColumn("fair", fair))
    # the level of the first source that is not full holds for it and all after it
    water = by_level.where("level > fair").agg(F.min(F.struct("level", "fair"))["fair"]).first()[0]
    full = F.lit(True) if water is None else F.col("level") <= F.lit(water)
    return by_level.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("weight") * F.lit(water)).alias("target"))


def running(df: DataFrame, order: list[Column], values: dict[str, Column], n: int) -> DataFrame:
    """df in the order of `order` over n range partitions (their number in __part), with running sums of `values` before each row.

    The rows are written once they are range-partitioned, so that both passes over them see the same partitions: the first
    sums each partition, the second adds those sums (n rows) to the sums inside it. Rows that agree in all of `order` must
    agree in `values`.
    """
    rows = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    whole = rows.groupBy("__part").agg(*[F.sum(v).alias(f"__sum_{k}") for k, v in values.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__base_{k}") for k in values])
    inner = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__own_{k}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for k, v in values.items()})
    rows = rows.join(F.broadcast(whole), F.col("__part") == F.col("__p"))
    return rows.select(*df.columns, "__part", *[(F.col(f"__own_{k}") + F.col(f"__base_{k}")).alias(k) for k in values])


def mix_key() -> Column:
    """The place of a document in its source's shuffle."""
    return F.xxhash64("doc_id", F.lit("mix"), "text")


def queue(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, mix_source, mix_key) of docs with size, source_size, target, before, taken, times.

    Every source's documents are shuffled by a hash of their content, and its queue holds them `most` times, in rounds of
    the same order. A document's virtual finish time is its queue's words up to its end divided by the source's target:
    `before` is the words before it in the first round, by prefix sums over hash ranges, so a source with most of the rows
    is spread over all tasks. All sources' documents are then range-sorted by finish time into one order, its running
    sum of words is taken, and the order is truncated at the total budget (all sources' whole targets). At that budget the
    virtual time is 1: of a document that is being served then only the words served by 1 count, at time 1. `taken` is a
    document's words before the truncation in all rounds; `times` has the finish time and range partition of each round in
    which it has any.

    Null text: size 0, nothing taken. Null source: the last source. Null doc_id: a row like others. Repeated rows are
    rows of their own, in any order among themselves. Empty table: no rows. All words zero: targets zero.
    """
    sized = docs.select("doc_id", F.col("source").alias("mix_source"), word_count(F.col("text")).alias("size"), mix_key().alias("mix_key"))
    sized = materialize(sized)
    n = rows_per_partition(docs)
    total = sized.groupBy("mix_source").agg(F.sum("size").alias("source_size")).withColumnRenamed("mix_source", "source")
    plan = materialize(targets(total, share, most, weights, n)).withColumnRenamed("source", "__named")
    budget = plan.agg(F.sum(F.floor("target"))).first()[0] or 0
    small = plan.count() <= 10_000
    on = F.col("mix_source").eqNullSafe(F.col("__named"))
    with_plan = lambda df: df.join(F.broadcast(plan) if small else plan, on).drop("__named")
    order = [F.col("mix_key"), F.col("doc_id"), F.col("size")]
    ranked = with_plan(prefix_sum(sized.where("size > 0"), ["mix_source"], F.col("size"), order, "before", n))
    rows = ranked.withColumn("__round", F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))))
    begin = F.col("__round") * F.col("source_size") + F.col("before")
    served = (begin < F.col("target")) & (begin + F.col("size") > F.col("target"))
    rows = rows.withColumn("__words", F.when(served, F.floor("target") - begin).otherwise(F.col("size")).cast("long"))
    rows = materialize(rows.withColumn("__time", F.when(served, 1.0).otherwise((begin + F.col("size")) / F.col("target"))))
    queued = running(rows, [F.col("__time"), F.col("mix_source"), F.col("before"), F.col("__round")], {"__done": F.col("__words")}, n)
    take = F.greatest(F.lit(0), F.least(F.col("__words"), F.lit(budget) - F.col("__done")))
    of = ["doc_id", "mix_source", "mix_key", "size", "source_size", "target", "before"]
    found = queued.groupBy(*of).agg(F.sum(take).cast("long").alias("taken"), F.array_sort(F.collect_list(F.when(take > 0, F.struct(F.col("__time").alias("time"), F.col("__part").alias("part"))))).alias("times"))
    nothing = with_plan(sized.where("size = 0")).withColumn("before", F.lit(0).cast("long")).withColumn("taken", F.lit(0).cast("long"))
    return found.unionByName(nothing.withColumn("times", F.array().cast(found.schema["times"].dataType)))


def mixture(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the columns of docs, once for each time that a document is taken, in order of virtual finish time.

    A document taken in part is in the mix whole: it straddles the budget, by less than its size for each source.
    Rows go to the range partitions of queue(), each sorted by finish time, so a reader that stops early has all sources
    in proportion. Documents without words are not in it.
    """
    columns = docs.columns
    on = ["__id", "__key", "__copy"]
    plan = materialize(queue(docs, share, most, weights).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("mix_key").alias("__key"), F.col("times").alias("__times")))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)], F.col("doc_id").alias("__id"), mix_key().alias("__key"))
    # rows that agree in id and text are told apart by a number; all others, nearly all, go straight to the join
    again = materialize(docs.select(F.col("doc_id").alias("__id"), mix_key().alias("__key")).groupBy("__id", "__key").count().where("count > 1").drop("count"))
    if again.isEmpty():
        plan, rows = plan.withColumn("__copy", F.lit(0).cast("long")), rows.withColumn("__copy", F.lit(0).cast("long"))
    else:
        plan, rows = numbered(plan, again, docs), numbered(rows, again, docs)
    cond = rows["__id"].eqNullSafe(plan["__id"]) & (rows["__key"] == plan["__key"]) & (rows["__copy"] == plan["__copy"])
    rows = rows.join(plan, cond).drop(*on).withColumn("__time", F.explode("__times")).drop("__times")
    rows = rows.repartitionById(rows_per_partition(docs), F.col("__time.part")).sortWithinPartitions("__time.time")
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])


def numbered(rows: DataFrame, again: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with __copy: 0, 1, ... among those whose key is in `again`, 0 for the rest."""
    a = again.select(F.col("__id").alias("__i"), F.col("__key").alias("__k"))
    on = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k"))
    twice = materialize(rows.join(a, on, "left_semi").withColumn("__n", F.monotonically_increasing_id()))
    twice = prefix_sum(twice, ["__id", "__key"], F.lit(1), [F.col("__n")], "__copy", rows_per_partition(docs)).drop("__n")
    once = rows.join(a, on, "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    return once.unionByName(twice.withColumn("__copy", F.col("__copy").cast("long")))
