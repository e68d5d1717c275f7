"""How far each source of a language departs from the language and from its other sources, term by term, in whole numbers.

Each group (language and source) and each language gives every kept term a probability in 10^-9 with one added to its count; the divergence of
p from q is (p - q)^2 / q, rounded down. Two reports:

`pair`: the sum over all kept terms for each two sources of a language. Nearly all terms are absent from nearly all sources, so the sum starts from the
value that all terms would have if absent, corrected by buckets of terms of one count for terms that one of both has, and by posting lists only
for terms that both have. A task adds up what its postings say about two sources before anything is exchanged.

`term`: the terms of the largest divergence from the language, by upper bounds. A bucket holds the terms of one count in a group; with the smallest
probability that the language gives any of them it bounds all. The buckets of the largest bounds are evaluated first, until they
hold as many terms as asked for; the worst of the best so far then leaves out every bucket whose bound is strictly below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.llm.batches import gathered_up
from pagelathe.llm.shared import KEY_ROWS, TO_LOWER, arrow_rows, bounded, byte_view, materialize, texts, word_codes, word_spans

#: By byte: letters, and all of other alphabets.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Probabilities are in units of 1 / UNIT.
UNIT = 1_000_000_000
#: Pairs of postings that are added up at once.
PAIRS = 1 << 20


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, documents): occurrences and documents of each term, summed within batches; rows of a key in several batches."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered_up(arrow):
            data, offs = byte_view(part.column("text"))
            data = TO_LOWER[data]
            starts, ends, first = word_spans(data, offs, IN_TERM)
            codes, terms = word_codes(data, starts, ends)
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            n = max(1, len(terms))
            key, count = np.unique(group[doc] * n + codes, return_counts=True)
            own = np.unique(doc * n + codes)
            _, documents = np.unique(group[own // n] * n + own % n, return_counts=True)
            of, term = key // n, key % n
            columns = [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), terms.take(pa.array(term)).cast(pa.large_string()).cast(pa.string()), pa.array(count), pa.array(documents)]
            for at in range(0, len(key), KEY_ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(at, KEY_ROWS) for c in columns], names=["lang", "source", "term", "count", "documents"])

    return texts(docs, "lang", "source", "text").mapInArrow(bounded(run), "lang string, source string, term string, count long, documents long")


def probability(count: str, n: str, v: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (N + V)), in decimals, since the product may leave a long."""
    return F.expr(f"1 + (cast({UNIT} as decimal(19,0)) * cast({count} + 1 as decimal(19,0))) div cast(greatest({n} + {v}, 1) as decimal(19,0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, count, lang_count): the terms of at least `least` documents of their language, a row for each source that has them."""
    sums = counted(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    same = Window.partitionBy("lang", "term")
    rows = sums.withColumns({"lang_count": F.sum("count").over(same), "__documents": F.sum("documents").over(same)})
    return rows.where(F.col("__documents") >= least).select("lang", "source", "term", "count", "lang_count")


def group_sums(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, lang_n, p0): each group that occurs, its occurrences of kept terms, the language's terms and occurrences, and p of an absent term."""
    per = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    terms = kept.groupBy("lang", "term").agg(F.first("lang_count").alias("c")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("lang_n"))
    rows = docs.select("lang", "source").distinct().join(per, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    return rows.withColumns({"p0": probability("0", "n", "v"), "gid": F.xxhash64("lang", "source")})


def count_buckets(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, count, terms, p, q): how many terms a group has of each count, their p, and the smallest q the language gives one of them."""
    rows = kept.groupBy("lang", "source", "count").agg(F.count("*").alias("terms"), F.min("lang_count").alias("least"))
    rows = rows.join(groups.select("lang", "source", "n", "v", "lang_n"), ["lang", "source"])
    return rows.select("lang", "source", "count", "terms", probability("count", "n", "v").alias("p"), probability("least", "lang_n", "v").alias("q"))


def pair_report(kept: DataFrame, groups: DataFrame, buckets: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each group and each other source of its language the sum over all kept terms."""
    g = groups.select("lang", "source", F.col("p0").alias("g0"), "v")
    o = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    ends = g.join(o, "lang").where("source != item").select("*", divergence("g0", "o0").alias("f0"))
    of = buckets.select("lang", "source", "terms", "p")
    exact = "decimal(38,0)"
    # all terms as if both lacked them
    none = ends.select("lang", "source", "item", (F.col("v").cast(exact) * F.col("f0")).cast(exact).alias("value"))
    # terms that the group has, as if the other lacked them, and the other way round
    one = ends.join(of, ["lang", "source"]).select("lang", "source", "item", (F.col("terms").cast(exact) * (divergence("p", "o0") - F.col("f0"))).cast(exact).alias("value"))
    other = ends.join(of.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("terms").cast(exact) * (divergence("g0", "p") - F.col("f0"))).cast(exact).alias("value"))
    both = shared_terms(kept, groups)
    names = groups.select("gid", "lang", "source")
    both = both.join(names, "gid").join(names.select(F.col("gid").alias("oid"), F.col("source").alias("item")), "oid").select("lang", "source", "item", "value")
    every = none.unionByName(one).unionByName(other).unionByName(both)
    return every.groupBy("lang", "source", "item").agg(F.expr("try_cast(sum(value) as bigint)").alias("value"))


def shared_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, oid, value): what the terms that two groups share add to what they would if each alone had them; from posting lists."""

    def added(g: np.ndarray, p: np.ndarray, p0: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        """Sums for some whole posting lists, each of `size` postings from `start`."""
        many = size * size
        list_of = np.repeat(np.arange(len(size)), many)
        within = np.arange(len(list_of)) - np.repeat(np.cumsum(many) - many, many)
        i, j = start[list_of] + within // size[list_of], start[list_of] + within % size[list_of]
        i, j = i[i != j], j[i != j]
        f = lambda x, y: (x - y) * (x - y) // y
        value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
        order = np.lexsort((g[j], g[i]))
        a, b = g[i][order], g[j][order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        total = np.add.reduceat(value[order], new) if len(a) else value
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(total)], names=["gid", "oid", "value"])

    def lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
        flat = table.column("postings").combine_chunks()
        size = pc.list_value_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        g, p, p0 = (pc.struct_field(pc.list_flatten(flat), c).to_numpy(zero_copy_only=False) for c in ("gid", "p", "p0"))
        start, ends, at = np.cumsum(size) - size, np.cumsum(size * size), 0
        while at < len(size):
            if size[at] ** 2 > PAIRS:  # a long list: some of its postings against all of them
                yield from long_list(g, p, p0, int(start[at]), int(size[at]))
                at += 1
                continue
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            yield added(g, p, p0, start[at:to], size[at:to])
            at = to

    def long_list(g: np.ndarray, p: np.ndarray, p0: np.ndarray, start: int, size: int) -> Iterator[pa.RecordBatch]:
        own = slice(start, start + size)
        step = max(1, PAIRS // size)
        for k in range(start, start + size, step):
            x = slice(k, min(start + size, k + step))
            f = lambda a, b: (a - b) * (a - b) // b
            left, left0 = p[x, None], p0[x, None]
            value = f(left, p[own]) - f(left, p0[own]) - f(left0, p[own]) + f(left0, p0[own])
            i, j = np.nonzero(g[x, None] != g[own])
            yield pa.RecordBatch.from_arrays([pa.array(g[x][i]), pa.array(g[own][j]), pa.array(value[i, j])], names=["gid", "oid", "value"])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in arrow:
            held.append(batch)
            if sum(b.nbytes for b in held) >= 8 << 20:
                yield from lists(pa.Table.from_batches(held))
                held = []
        if held:
            yield from lists(pa.Table.from_batches(held))

    rows = kept.join(groups.select("lang", "source", "n", "v", "p0", "gid"), ["lang", "source"]).select("lang", "term", "gid", probability("count", "n", "v").alias("p"), "p0")
    postings = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("postings")).where(F.size("postings") > 1).select("postings")
    arrow_rows(kept.sparkSession, KEY_ROWS)
    some = postings.mapInArrow(bounded(run), "gid long, oid long, value long")
    return some.groupBy("gid", "oid").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("decimal(38,0)").alias("value"))


def term_report(kept: DataFrame, groups: DataFrame, buckets: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the `top` terms of each group by divergence from the language."""
    bounds = buckets.where("p > q").select("lang", "source", "count", "terms", divergence("p", "q").alias("bound"))
    before = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "count").rowsBetween(Window.unboundedPreceding, -1)
    bounds = materialize(bounds.withColumn("before", F.coalesce(F.sum("terms").over(before), F.lit(0))))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def best(some: DataFrame) -> DataFrame:
        rows = kept.join(some.select("lang", "source", "count"), ["lang", "source", "count"]).join(groups.select("lang", "source", "n", "v", "lang_n"), ["lang", "source"])
        rows = rows.withColumns({"p": probability("count", "n", "v"), "q": probability("lang_count", "lang_n", "v")}).where("p > q")
        rows = rows.select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
        return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    first = materialize(best(bounds.where(F.col("before") < top)))
    worst = first.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("worst"))
    # a group with fewer than `top` terms so far has no worst one yet: all of its buckets count
    rest = bounds.where(F.col("before") >= top).join(worst, ["lang", "source"], "left").where("worst is null or bound >= worst")
    rows = first.drop("rank").unionByName(best(rest).drop("rank"))
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)


def audit(docs: DataFrame, top: int = 200, least: int = 3) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of docs (text, lang, source).

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z in lower case; a language keeps those of at least `least` of its rows. Part
    `pair`: item is each other source of the language, ranked whole; without kept terms the value is 0. Part `term`: item is a
    term of the group that it has more often than the language, to rank `top`. Ties come by the item's bytes. Null text, lang or source: empty.
    Repeated rows, and rows that share an id, are documents each. A group without terms is compared like others and has no rows of `term`. Empty
    table: no rows. Other columns are not read. A value that a long cannot hold is null.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = materialize(kept_terms(docs, least))
    groups = materialize(group_sums(docs, kept))
    buckets = materialize(count_buckets(kept, groups))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_report(kept, groups, buckets).withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = term_report(kept, groups, buckets, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
