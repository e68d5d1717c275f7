"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.components import components, forest, span_links, spanned
from pagelathe.llm.shared import KEY_ROWS, TO_LOWER, arrow_rows, bounded, byte_view, materialize, rows_per_partition, screened, slices, texts, word_spans

BITS = 64


def shingle_slice(texts: pa.Array, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts after one another, and each text's number of them. A text of fewer words is one shingle."""
    data, offs = byte_view(texts)
    data = TO_LOWER[data]
    starts, ends, first = word_spans(data, offs)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if a == b:
            continue
        s, e = starts[a:b], ends[a:b]
        lo, hi = int(s[0]), int(e[-1])
        # one blank between words: shingles are then slices of one string
        if int((e - s).sum()) + (b - a - 1) == hi - lo and np.all(data[e[:-1]] == 32):
            text, size = raw[lo:hi], None
        else:
            text, size = b" ".join(raw[lo:hi].split()), e - s
        if size is None:
            at, to = (s - lo).tolist(), (e - lo).tolist()
        else:
            ends_ = np.cumsum(size + 1) - 1
            at, to = (ends_ - size).tolist(), ends_.tolist()
        if b - a < words:
            hashes.append(digest(text, seed))
            counts[i] = 1
        else:
            hashes.extend([digest(text[x:y], seed) for x, y in zip(at, to[words - 1 :], strict=False)])
            counts[i] = b - a - words + 1
    return np.array(hashes, np.uint64), counts


def fingerprint_slice(texts: pa.Array, words: int, seed: int, lanes: int = 1) -> np.ndarray:
    """SimHash of each text, (texts, lanes) of int64: majority of the bits of its shingles' XXH64; further lanes take
    hashes of those. A text without words has zeros."""
    return majorities(*shingle_slice(texts, words, seed), lanes)


def majorities(h: np.ndarray, counts: np.ndarray, lanes: int) -> np.ndarray:
    doc = np.repeat(np.arange(len(counts)), counts)
    lane = [h, *(mixed(h ^ mixed(np.array([k], np.uint64))) for k in range(1, lanes))]
    return np.stack([majority(x, doc, counts) for x in lane], axis=1).view(np.int64)


def shingle_sets(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [np.unique(h[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


#: The bits of each byte, lowest first.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def majority(h: np.ndarray, doc: np.ndarray, counts: np.ndarray, most: int = 4096) -> np.ndarray:
    """For each text the bits that over half of its hashes have: byte values are counted, then bits summed over them."""
    out = np.zeros(len(counts), np.uint64)
    cut = np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, len(counts), most):
        b = min(len(counts), a + most)
        own, at = h[cut[a] : cut[b]], (doc[cut[a] : cut[b]] - a) * 256
        for k in range(8):
            byte = ((own >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
            ones = np.bincount(at + byte, minlength=(b - a) * 256).reshape(-1, 256) @ BYTE_BITS
            bits = (2 * ones > counts[a:b, None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)
            out[a:b] |= bits.sum(axis=1, dtype=np.uint64) << np.uint64(8 * k)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Another hash of hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp: long) for every row of docs. Null or empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprint_slice(part.column("text"), words, seed)[:, 0]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return texts(docs, "doc_id", "text").mapInArrow(bounded(run), "doc_id long, fp long")


def random_pivots(count: int, lanes: int, seed: int = 5) -> np.ndarray:
    """Reference fingerprints (count, lanes): random, and the same for every run."""
    return np.random.default_rng(seed).integers(0, 1 << 64, (count, lanes), dtype=np.uint64)


def block_pivots(blocks: int, each: int = 12, seed: int = 6) -> np.ndarray:
    """Reference fingerprints (1 + blocks * each): zero, and for each of `blocks` ranges of bits some that are zero outside it.

    The difference between the distances to one of a block and to zero depends on the bits of that block alone, and by
    the triangle inequality it is the same for fingerprints that agree there.
    """
    rng, out = np.random.default_rng(seed), [0]
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    for a, b in zip(edges, edges[1:], strict=False):
        out += [int(x) << a for x in rng.integers(1, 1 << (b - a), each)]
    return np.array(out, np.uint64)


def pivot_distances(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (n, lanes) to reference fingerprints (pivots, lanes), as bytes; over 255 is 255."""
    out = np.zeros((len(fp), len(refs)), np.uint16)
    for k in range(fp.shape[1]):
        out += np.bitwise_count(fp[:, k, None] ^ refs[None, :, k])
    return np.minimum(out, 255).astype(np.uint8)


def group_keys(table: np.ndarray, blocks: int, each: int, agreeing: int) -> np.ndarray:
    """Keys (n, choices) of a table of distances to block_pivots(): one for each choice of `agreeing` blocks, from their coordinates."""
    rows = (table[:, 1 : 1 + blocks * each].astype(np.int64) - table[:, :1]).reshape(len(table), blocks, each)
    rng = np.random.default_rng(8)
    turn = rng.integers(1, 1 << 62, (blocks, each), dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        own = (rows * turn).sum(axis=2)  # a number for the coordinates of each block
        return np.stack([mixed(own[:, list(c)].sum(axis=1).astype(np.uint64) + np.uint64(t)).view(np.int64) for t, c in enumerate(combinations(range(blocks), agreeing))], axis=1)


def close(fp: np.ndarray, table: np.ndarray, distance: int):
    """near(x, rest) of components.forest(): the largest coordinate difference discards, all bits decide."""
    wide = table.astype(np.int16)

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        ok = np.abs(wide[rest] - wide[x]).max(axis=1) <= distance
        some = rest[ok]
        ok[ok] = np.bitwise_count(fp[some] ^ fp[x]).sum(axis=1) <= distance
        return ok

    return near


def small_groups(fp: np.ndarray, table: np.ndarray, groups: list[tuple[int, int]], distance: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the linked sets of each group (a, b) of rows: small groups of a size at once, larger ones one by one."""
    begin, size = np.array([a for a, _ in groups]), np.array([b - a for a, b in groups])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(size[size <= small]).tolist():
        own = begin[size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, 200_000 // (s * s))
        for k in range(0, len(own), step):
            rows = own[k : k + step, None] + np.arange(s)
            x, y = rows[:, i].ravel(), rows[:, j].ravel()
            # a few coordinates first, then all, then the bits
            for c in (slice(0, 4), slice(4, None)):
                ok = np.abs(table[x, c].astype(np.int16) - table[y, c].astype(np.int16)).max(axis=1, initial=0) <= distance
                x, y = x[ok], y[ok]
            ok = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1) <= distance
            left.append(x[ok])
            right.append(y[ok])
    for a, b in zip(begin[size > small].tolist(), (begin + size)[size > small].tolist(), strict=True):
        x, y, _ = forest(b - a, close(fp[a:b], table[a:b], distance))
        left.append(a + np.array(x, np.int64))
        right.append(a + np.array(y, np.int64))
    return np.concatenate(left), np.concatenate(right)


def print_links(lanes: int, distance: int):
    """`work` of span_links() on fp and pivots (binary): links of `distance` bits or fewer."""

    def work(table: pa.Table, cut: list[int]) -> pa.RecordBatch | None:
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(table.num_rows, lanes)
        coords = np.frombuffer(b"".join(table.column("pivots").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        return spanned(table, cut, lambda a, b: close(fp[a:b], coords[a:b], distance), lambda groups: small_groups(fp, coords, groups, distance))

    return work


def blocks_for(n: int, distance: int) -> int:
    """Blocks of bits for n fingerprints: with more of them more must agree, so that groups by chance stay small."""
    return distance + (2 if n <= 1 << 22 else 3 if n <= 1 << 27 else 4)


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, seed: int = 42, blocks: int | None = None, each: int = 12, n_pivots: int = 16, block: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: SimHash groups linked at `distance` bits or fewer.

    Equal fingerprints count once (a grouped minimum), so exact copies make no pairs. The table of pivot distances is
    computed once: each distinct fingerprint's Hamming distances to block_pivots() and `n_pivots` random references. Two
    fingerprints within `distance` bits agree in all bits of at least blocks - distance blocks, so in all pivot coordinates
    of those: each choice of so many blocks is a join on equal coordinates, and no pair is lost. What meets there is
    discarded by the largest difference over all coordinates, and the survivors are verified by their bits.

    Null doc_id: the row is linked like others and never gives a component its id unless all of it is null. Null,
    empty or blank text: fingerprint 0. Rows with the same doc_id each give a row. Empty table: no rows.
    Other columns of docs are not read.
    """
    rows = materialize(fingerprints(docs, words, seed))
    first = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    blocks = blocks or blocks_for(first.count(), distance)
    refs = np.concatenate([block_pivots(blocks, each), random_pivots(n_pivots, 1)[:, 0]])[:, None]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy()
            fp = signed.view(np.uint64)[:, None]
            table = pivot_distances(fp, refs)
            keys = group_keys(table, blocks, each, blocks - distance)
            raw = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (fp, table)]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), *raw, pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))], names=["pid", "fp", "pivots", "keys"])

    arrow_rows(docs.sparkSession, KEY_ROWS)
    table = materialize(first.select("fp").mapInArrow(bounded(measure), "pid long, fp binary, pivots binary, keys array<long>"))
    members = table.select(F.explode("keys").alias("gid"), "pid", F.lit(0).cast("long").alias("weight"))
    links = span_links(members, table.select("pid", "fp", "pivots"), print_links(1, distance), block, rows_per_partition(docs))
    comp = materialize(components(links))
    named = first.join(comp, first["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # the groups' ids go back to fingerprints, and from those to rows
    by_fp = named.join(ids, "component").select(F.col("fp").alias("f"), "component_id")
    return rows.join(by_fp, rows["fp"] == by_fp["f"]).select("doc_id", "fp", "component_id")


def band_keys(sets: list[np.ndarray], bands: int, rows: int, seed: int = 9) -> list[np.ndarray]:
    """For each set of hashes `bands` keys, each from `rows` minima under hashes of their own; none for an empty set."""
    size = np.array([len(s) for s in sets])
    own = np.flatnonzero(size)
    out = [np.zeros(0, np.int64)] * len(sets)
    if not len(own):
        return out
    h, at = np.concatenate(sets), (np.cumsum(size) - size)[own]
    rng = np.random.default_rng(seed)
    keys = np.zeros((len(own), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(own), band, np.uint64)
        for _ in range(rows):
            by, off = (rng.integers(1, 1 << 63, dtype=np.uint64) for _ in range(2))
            key = mixed(key * np.uint64(31) + np.minimum.reduceat((h ^ off) * (by | np.uint64(1)), at))
        keys[:, band] = key
    for k, i in enumerate(own.tolist()):
        out[i] = keys[k].view(np.int64)
    return out


def similar_sets(codes: np.ndarray, offs: np.ndarray, similarity: float):
    """near(x, rest) of components.forest(): sets (codes[offs[i]:offs[i + 1]]) whose exact Jaccard similarity is `similarity` or more."""
    size = np.diff(offs)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    total = np.zeros(len(codes) + 1, np.int64)

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        own = codes[offs[x] : offs[x + 1]]
        mark[own] = True
        np.cumsum(mark[codes], out=total[1:])
        mark[own] = False
        both = total[offs[rest + 1]] - total[offs[rest]]
        return (both > 0) & (both >= similarity * (size[x] + size[rest] - both) - 1e-9)

    return near


def set_links(similarity: float):
    """`work` of span_links() on shingles (binary)."""

    def work(table: pa.Table, cut: list[int]) -> pa.RecordBatch | None:
        raw = table.column("shingles").to_pylist()

        def near_of(a: int, b: int):
            offs = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw[a:b]])]).astype(np.int64)
            codes = np.unique(np.frombuffer(b"".join(raw[a:b]), np.uint64), return_inverse=True)[1]
            return similar_sets(codes, offs, similarity)

        return spanned(table, cut, near_of)

    return work


def packed(values: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([8 * len(x) for x in values])]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offs), pa.py_buffer(b"".join(x.tobytes() for x in values))])


def row_id():
    """Names a row by id and text; rows that agree in it are the same document twice."""
    return F.xxhash64("doc_id", F.lit("near"), "text")


PRINTS = "doc_id long, rid long, pid long, fp binary, pivots binary, keys array<long>"


def similar_documents(docs: DataFrame, words: int = 5, seed: int = 42, lanes: int = 4, distance: int = 64, n_pivots: int = 32, bands: int = 10, rows: int = 4, block: int = 1024, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, rid, pid) of docs, and the text classes (pid, component): links at an exact shingle similarity of `similarity` or more.

    Similarity is Jaccard over the distinct shingles; texts of equal sets are one pid from the start. Texts at 0.8 have
    fingerprints 15 percent of bits apart, too far for coordinates that must agree, and sampled bits take a number of
    tables that grows with the corpus. So texts meet by `bands` keys of `rows` shingle minima each, as many at any size: a pair
    at 0.8 shares one with a chance of 0.995. What meets is discarded by the largest difference of its distances to
    `n_pivots` reference fingerprints and then by all bits of its SimHash (of 256 bits 38.8 differ at 0.8, with a deviation
    of 5.7; `distance` is 4.4 deviations above). Candidates that hang together are compared by their shingles, any two of
    them, and only those link that reach `similarity`.
    """
    refs = random_pivots(n_pivots, lanes)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, counts = shingle_slice(part.column("text"), words, seed)
                sets = shingle_sets(h, counts)
                fp = majorities(np.concatenate(sets) if sets else h, np.array([len(s) for s in sets], np.int64), lanes).view(np.uint64)
                pid = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
                raw = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (fp, pivot_distances(fp, refs))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(pid), *raw, pa.array(band_keys(sets, bands, rows), pa.list_(pa.int64()))], names=["doc_id", "rid", "pid", "fp", "pivots", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("pid"), packed(shingle_sets(*shingle_slice(part.column("text"), words, seed)))], names=["pid", "shingles"])

    n = rows_per_partition(docs)
    found = materialize(texts(docs.select("doc_id", row_id().alias("rid"), "text")).mapInArrow(bounded(prints), PRINTS))
    points = materialize(found.groupBy("pid", "fp", "pivots", "keys").agg(F.min("rid").alias("rid")))
    keys = points.select(F.explode("keys").alias("gid"), "pid")
    sizes = keys.groupBy("gid").agg(F.count("*").alias("weight")).where("weight > 1")
    members = materialize(keys.join(sizes, "gid"))
    near = span_links(members, points.select("pid", "fp", "pivots"), print_links(lanes, distance), block, n)
    weights = members.groupBy("pid").agg(F.sum("weight").alias("weight")).withColumnRenamed("pid", "w")
    groups = components(near).join(points.select("pid", "rid"), F.col("node") == F.col("pid")).join(weights, F.col("pid") == F.col("w"))
    groups = materialize(groups.select(F.col("component").alias("gid"), "pid", "rid", "weight"))
    named = docs.select(row_id().alias("r"), "text")
    own = groups.select("pid", "rid")
    meant = screened(named, "r", own, "rid")[0].join(own.hint("merge"), F.col("r") == F.col("rid"))
    mine = meant.select("pid", "text")
    held = materialize(texts(mine.dropDuplicates(["pid"])).mapInArrow(bounded(sets), "pid long, shingles binary"))
    comp = materialize(components(span_links(groups.select("gid", "pid", "weight"), held, set_links(similarity), block // 2, n)))
    classes = points.join(comp, points["pid"] == comp["node"], "left").select("pid", F.coalesce("component", "pid").alias("component"))
    return found.select("doc_id", "rid", "pid"), classes


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row for each class of similar_documents(): the one with the smallest doc_id, null last.

    A row is named by id and text together, so unlike texts under one doc_id both stay, and of rows that agree in both one
    stays. Null, empty and blank texts are alike. Empty table: no rows.
    """
    found, classes = similar_documents(docs, **options)
    named = materialize(found.join(classes.withColumnRenamed("pid", "p"), F.col("pid") == F.col("p")).groupBy("component", "doc_id", "rid").agg(F.count("*").alias("times")))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("stays")).withColumnRenamed("component", "c")
    # only rows that go, and those that are there more than once, need an exchange of texts
    marked = named.join(first, F.col("component") == F.col("c")).select("rid", (F.col("rid") == F.col("stays")).alias("stays"), "times")
    marked = materialize(marked.where("not stays or times > 1"))
    if marked.isEmpty():
        return docs
    row = "__row"
    rows = docs.withColumn(row, row_id())
    gone = marked.where("not stays").select(F.col("rid").alias("__gone")).hint("merge")
    again = marked.where("stays").select(F.col("rid").alias("__again")).hint("merge")
    some, passed = screened(rows, row, marked, "rid")
    stay = some.join(gone, F.col(row) == F.col("__gone"), "left_anti")
    out = [passed, stay.join(again, F.col(row) == F.col("__again"), "left_anti"), stay.join(again, F.col(row) == F.col("__again"), "left_semi").dropDuplicates([row])]
    return reduce(DataFrame.unionByName, [df.select(docs.columns) for df in out])
