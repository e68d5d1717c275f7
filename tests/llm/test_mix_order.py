"""The queue: reruns with other settings take the same documents, and the order is cut where the budget ends."""

from collections import defaultdict

from pyspark.sql import functions as F

from pagelathe.llm import mixing


def test_order_does_not_depend_on_the_number_of_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def taken(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return {r["doc_id"]: (r["before"], r["taken"]) for r in mixing.queue(docs).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert taken("4") == taken("64")


def test_queue_is_cut_in_order_of_finish_times(spark):
    """A hot source, repeated rows and ties against fair queueing one document at a time."""
    rows = [(i, "w " * (1 + i % 7), "en", "hot", 0) for i in range(400)] + [(1000 + i, "w " * (1 + i % 50), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(5, "w w w", "en", None, 0)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.queue(docs).collect()
    queues, target = defaultdict(list), {}
    for r in sorted((r for r in got if r["size"]), key=lambda r: r["before"]):
        queues[r["mix_source"]].append(r)
        target[r["mix_source"]] = r["target"]
    order = []
    for s, q in queues.items():
        total = 0
        for k in range(2):
            for r in q:
                assert k or r["before"] == total
                end = total + r["size"]
                inside = total < target[s] < end
                order.append((1.0 if inside else end / target[s], s or "~", k, r["before"], s, int(target[s]) - total if inside else r["size"]))
                total = end
    left, want = sum(int(t) for t in target.values()), defaultdict(int)
    for _, _, _, at, s, words in sorted(order):
        want[s, at] += min(words, left)
        left -= min(words, left)
    assert {(r["mix_source"], r["before"]): r["taken"] for r in got} == want
    assert left == 0


def test_mixture_comes_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    times = {r["doc_id"]: [x["time"] for x in r["times"]] for r in mixing.queue(docs).collect()}
    seen, last = defaultdict(int), 0.0
    for r in mixing.mixture(docs).withColumn("p", F.spark_partition_id()).collect():
        now = times[r["doc_id"]][seen[r["doc_id"]]]
        seen[r["doc_id"]] += 1
        assert now >= last
        last = now
    assert all(seen[i] == len(t) for i, t in times.items())
