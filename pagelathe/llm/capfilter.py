"""Embedding near-duplicates by spherical-cap filters with list decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.components import block_pairs, by_groups, components
from pagelathe.llm.shared import bounded, materialize, rows_per_partition


def cap_height(dim: int, share: float) -> float:
    """The height at which a cap holds `share` of the unit sphere of `dim` dimensions."""
    if dim < 3:
        return float(np.quantile(np.cos(np.linspace(0, np.pi, 4001)), 1 - share)) if dim == 2 else (1.0 if share <= 0.5 else -1.0)
    t = np.linspace(1, -1, 400_001)
    area = np.cumsum((1 - t * t) ** ((dim - 3) / 2))
    return float(t[np.searchsorted(area, share * area[-1])])


@dataclass(frozen=True)
class Code:
    """A random product code: after a random rotation the space is cut into `blocks` parts, each with `words`
    random directions; a filter is one direction of each part, `words ** blocks` filters in all.
    `listed` is the mean number of filters whose cap holds a random vector; the cap's height follows from it."""

    dim: int
    blocks: int
    words: int
    listed: int
    seed: int
    parts: tuple = field(init=False, compare=False, repr=False)
    height: float = field(init=False, compare=False)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        turn = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        cuts = np.linspace(0, self.dim, self.blocks + 1).astype(int)
        parts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            c = rng.standard_normal((self.words, b - a))
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            parts.append(turn[:, a:b] @ c.T / np.sqrt(self.blocks))
        object.__setattr__(self, "parts", tuple(parts))
        object.__setattr__(self, "height", cap_height(self.dim, min(1.0, self.listed / self.words**self.blocks)))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters at or above the height, by extending partial filters that can still reach it."""
        scores = [x @ p for p in self.parts]
        best = np.zeros((len(x), self.blocks + 1))
        for k in range(self.blocks - 1, -1, -1):
            best[:, k] = best[:, k + 1] + scores[k].max(axis=1)
        row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k in range(self.blocks):
            found, step = [], max(1, 2_000_000 // self.words)
            for at in range(0, max(1, len(row)), step):
                r, c, t = row[at : at + step], code[at : at + step], total[at : at + step]
                grown = t[:, None] + scores[k][r]
                i, j = np.nonzero(grown + best[r, k + 1][:, None] >= self.height - 1e-12)
                found.append((r[i], c[i] * self.words + j, grown[i, j]))
            row, code, total = (np.concatenate(x) for x in zip(*found, strict=True))
        return row, code


@dataclass(frozen=True)
class Codes:
    """`turns` product codes with rotations of their own, which even out the number of filters of a vector."""

    turns: int = 12
    blocks: int = 2
    words: int = 48
    listed: int = 4
    seed: int = 11

    @staticmethod
    def for_points(n: int, per_point: int = 16) -> Codes:
        """Codes with `per_point` filters for each of n points that may link, so that what meets a random vector by chance
        stays as little at any size; caps shrink as the corpus grows, which costs little recall at small angles."""
        return Codes(words=max(24, int(np.ceil(np.sqrt(per_point * max(1, n))))))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters of unit vectors x, by row and filter."""
        blocks = min(self.blocks, x.shape[1])
        found = [code_for(x.shape[1], blocks, self.words, self.listed, self.seed + t).decode(x) for t in range(self.turns)]
        row = np.concatenate([r for r, _ in found])
        f = np.concatenate([c + t * self.words**blocks for t, (_, c) in enumerate(found)])
        order = np.lexsort((f, row))
        return row[order], f[order]


@lru_cache(maxsize=64)
def code_for(dim: int, blocks: int, words: int, listed: int, seed: int) -> Code:
    return Code(dim, blocks, words, listed, seed)


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that can link (same length, finite, not zero), by length, and their unit vectors in double precision."""
    a = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    out = []
    for x in a.to_pylist() if a.null_count or a.flatten().null_count else a.to_numpy(zero_copy_only=False):
        v = None
        if x is not None and len(x) and not any(y is None for y in x):
            v = np.asarray(x, np.float64)
            top = np.abs(v).max()
            v = v / top if np.isfinite(top) and top > 0 else None  # scaled first: squares neither overflow nor vanish
            if v is not None:
                v = v / np.sqrt((v * v).sum())
        out.append(v)
    good = [i for i, v in enumerate(out) if v is not None]
    return np.array(good, np.int64), [out[i] for i in good]


def filtered(points: DataFrame, codes: Codes) -> DataFrame:
    """(pid, label, dim, vector: binary, filters: array<long>) of each point that can link."""
    width = np.float64 if "double" in dict(points.dtypes)["embedding"] else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, units = unit_rows(batch.column("embedding"))
            dims = np.array([len(u) for u in units], np.int64)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                for at in range(0, len(own), 256):
                    some = own[at : at + 256]
                    row, f = codes.decode(np.stack([units[i] for i in some]))
                    offs = np.searchsorted(row, np.arange(len(some) + 1))
                    take = pa.array(good[some])
                    raw = [np.asarray(v, width).tobytes() for v in batch.column("embedding").take(take).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("pid").take(take), batch.column("label").take(take), pa.array(np.full(len(some), d, np.int32)), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(f))],
                        names=["pid", "label", "dim", "vector", "filters"],
                    )

    return points.select("pid", "label", "embedding").mapInArrow(bounded(run), "pid long, label string, dim int, vector binary, filters array<long>")


def group_links(x: np.ndarray, side: np.ndarray, lists: list[np.ndarray], f: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a group with cosine >= least whose smallest common filter is f: each pair in one group only."""
    low = [v[v < f] for v in lists]
    names, inverse = np.unique(np.concatenate(low), return_inverse=True)
    who = np.repeat(np.arange(len(x)), [len(v) for v in low])
    cos = x @ x.T
    linked = np.triu(cos >= least, 1)
    if side.any():
        linked = (cos >= least) & (side[:, None] == 0) & (side[None, :] == 1)
    if len(names) and linked.any():
        has = np.zeros((len(x), len(names)), np.float32)
        has[who, inverse] = 1
        linked &= has @ has.T == 0
    return np.nonzero(linked)


def units_of(raw: pa.ChunkedArray | pa.Array, dim: int, width: type) -> np.ndarray:
    """The unit vectors (n, dim) of vectors as bytes, in double precision."""
    x = np.frombuffer(b"".join(raw.to_pylist()), width).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_groups(x: np.ndarray, begin: np.ndarray, end: np.ndarray, least: float, most: int = 16) -> np.ndarray:
    """Which groups of rows may hold a link: of up to `most` rows those with a pair near `least` or above, all of a size at once; of more all."""
    size = end - begin
    ok = size > most
    for s in np.unique(size[(size > 1) & ~ok]).tolist():
        own = np.flatnonzero(size == s)
        i, j = np.triu_indices(s, 1)
        step = max(1, 500_000 // (len(i) * x.shape[1]))
        for k in range(0, len(own), step):
            at = begin[own[k : k + step], None]
            ok[own[k : k + step]] = (np.einsum("gpd,gpd->gp", x[at + i], x[at + j]) >= least - 1e-9).any(axis=1)
    return ok


def embedding_links(vectors: DataFrame, least: float = 0.93, codes: Codes | None = None, block: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine in double precision is `least` or more. Equal
    vectors of a label are one point with a multiplicity, so copies make no pairs. Each point is list-decoded to all
    filters whose cap holds it; points meet in a filter and are verified there. There are as many filters as the largest
    label's points need (Codes.for_points), so that the points that share one with a point by chance do not grow in number. A pair counts in its smallest common
    filter only, so n_links needs no distinct over pairs; a group gives each point's number of links and a link to
    the smallest neighbour that it found, never the pairs. Recall is measured against brute force in the tests.

    A label of any type counts as its text. Null label, null or zero vector, null or non-finite components: a component of its own, no links. Null vec_id:
    counted in others' links, gives no component its id. Repeated rows each give a row and link with each other.
    Vectors of different length do not link. Empty table: no rows.
    """
    plain = F.transform("embedding", lambda v: v + F.lit(0).cast("byte"))  # -0.0 becomes 0.0
    vectors = vectors.select("vec_id", F.col("label").cast("string").alias("label"), plain.alias("embedding"))
    points = materialize(
        vectors.where("label is not null and embedding is not null")
        .groupBy("label", "embedding")
        .agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
        .withColumn("pid", F.xxhash64("label", "embedding"))
    )
    n = rows_per_partition(vectors)
    codes = codes or Codes.for_points(points.groupBy("label").count().agg(F.max("count")).first()[0] or 1)
    units = materialize(filtered(points, codes))
    members = units.select("pid", "label", "dim", F.explode("filters").alias("f"))
    key = ["label", "dim", "f"]
    width = np.float64 if "double" in dict(vectors.dtypes)["embedding"] else np.float32

    def work(table: pa.Table, x: np.ndarray, a: int, b: int) -> pa.RecordBatch | None:
        part, x = table.slice(a, b - a), x[a:b]
        f = part.column("f")[0].as_py()
        i, j = group_links(x, part.column("side").to_numpy(), [np.asarray(v) for v in part.column("filters").to_pylist()], f, least)
        if not len(i):
            return None
        pid, count = part.column("pid").to_numpy(), part.column("times").to_numpy()
        links = np.bincount(i, count[j], b - a) + np.bincount(j, count[i], b - a)
        far = pid.copy()
        np.minimum.at(far, i, pid[j])
        np.minimum.at(far, j, pid[i])
        # the smallest neighbour alone does not span a group: a forest of it does
        forest = spanning(i, j, b - a)
        own = np.flatnonzero(links)
        ids = np.concatenate([pid[own], pid[[y for _, y in forest]]])
        to = np.concatenate([far[own], pid[[x for x, _ in forest]]])
        sums = np.concatenate([links[own], np.zeros(len(forest))]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(to), pa.array(sums)], names=["a", "b", "links"])

    # names first: a filter of one point goes before the vectors join
    whole = units.select(F.col("pid").alias("u"), "vector", "filters").join(points.select(F.col("pid").alias("p"), "times"), F.col("u") == F.col("p")).drop("p")
    dealt = block_pairs(members, key, "pid", block).join(whole, F.col("pid") == F.col("u")).select(*key, "g0", "g1", "side", "pid", "times", "vector", "filters")
    def groups(table: pa.Table, cut: list[int]) -> pa.RecordBatch | None:
        # by length of the vectors: a batch may hold groups of several
        starts, out = np.array(cut), []
        dims = table.column("dim").to_numpy()[starts[:-1]]
        for d in np.unique(dims).tolist():
            own = np.flatnonzero(dims == d)
            rows = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in own])
            x = np.zeros((table.num_rows, d))
            x[rows] = units_of(table.column("vector").take(pa.array(rows)), d, width)
            out += [got for g in own[linked_groups(x, starts[own], starts[own + 1], least)] if (got := work(table, x, int(starts[g]), int(starts[g + 1]))) is not None]
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    found = materialize(by_groups(dealt, [*key, "g0", "g1"], groups, "a long, b long, links long", n))
    comp = materialize(components(found.select("a", "b")))
    sums = found.groupBy(F.col("a").alias("q")).agg(F.sum("links").alias("links"))
    usable = units.select(F.col("pid").alias("u"))
    named = (
        points.join(usable, points["pid"] == usable["u"])
        .join(comp, F.col("pid") == F.col("node"), "left")
        .join(sums, F.col("pid") == F.col("q"), "left")
        .select("pid", "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "pid").alias("component"))
    )
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    point = named.join(ids, "component").select(F.col("pid").alias("p"), "n_links", "component_id")
    rows = vectors.select("vec_id", F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")).alias("pid"))
    out = rows.join(point, rows["pid"] == point["p"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.when(F.col("p").isNotNull(), F.col("component_id")), F.col("vec_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[q] = p
            out.append((x, y))
    return out
