"""Toxicity scores: boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pagelathe.llm.shared import TO_LOWER, bounded, byte_view, materialize, slices, texts, word_codes, word_spans

#: Insults that any corpus in English has; the rest of the lexicon is learned (fixed values).
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb imbecile fool fools loser losers scum trash garbage pathetic worthless "
    "disgusting clown clowns jerk bastard bitch whore slut crap shit bullshit fuck fucking fucker asshole retard retarded dumbass "
    "vermin filth filthy parasite subhuman freak creep ugly hate kill die coward liar cretin dimwit halfwit nitwit twit weasel pig".split()
)
SECOND_PERSON = frozenset("you your yours yourself youre ya u ur du dich dir dein deine sie ihr euch tu te toi ton ta tes vous votre usted tú ti tus vosotros".split())
#: Look-alikes that hide letters.
LEET = str.maketrans("013457@$!", "oieastasi")
FEATURES = (
    "insults", "insult_rate", "learned", "learned_rate", "learned_weight", "learned_top", "near_you", "you_rate", "capital_rate", "capital_words",
    "exclamations", "questions", "punctuation_rate", "repeat_rate", "obfuscated_rate", "spelled_rate", "hidden_insults", "digit_rate", "mean_word", "log_words",
)
#: Labelled rows (an id and two small numbers each) that are broadcast to find their texts, at most.
BROADCAST_ROWS = 200_000
#: Words between an insult and a second-person word, at most.
NEAR = 4


def _table(marks: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(marks)] = True
    return out


UPPER, DIGIT = _table(bytes(range(65, 91))), _table(b"0123456789")
LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
PUNCTUATION, HIDING = _table(b".,;:!?\"'()[]{}*#-|/"), _table(b"0123456789@$!*")


@dataclass(frozen=True)
class Settings:
    """`lexicon_rows` and `fit_rows`: about how many labelled rows at most the lexicon and the trees are fitted on (a
    share by hash of the id); `lexicon_words`: most words learned. They bound the classifier, not what it scores."""

    lexicon_rows: int = 40_000
    fit_rows: int = 40_000
    lexicon_words: int = 4_000
    word_rows: int = 3
    odds: float = 4.0
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 32
    least_leaf: float = 2.0


def letters_in(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts belong to letters: ASCII letters, and all beyond ASCII but signs and punctuation.

    Those are U+0080 to U+00BF but for the letters among them, the signs for times and division, U+2000 to U+206F (quotes, dashes, blanks), and U+3000 to U+303F
    but for the marks that stand for a letter.
    """
    w = LETTER[data]
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        two = np.flatnonzero(((a == 0xC2) & ~np.isin(b, (0xAA, 0xB5, 0xBA))) | ((a == 0xC3) & np.isin(b, (0x97, 0xB7))))
        w[two] = w[two + 1] = False
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        three = np.flatnonzero(((a == 0xE2) & ((b == 0x80) | ((b == 0x81) & (c <= 0xAF)))) | ((a == 0xE3) & (b == 0x80) & ~np.isin(c, (0x85, 0x86, 0x87))))
        w[three] = w[three + 1] = w[three + 2] = False
    return w


def words_in(data: np.ndarray, offs: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(starts, ends, first, codes, names) of all words, runs of letters, in lower case: what lexicon and features both count."""
    starts, ends, first = word_spans(data, offs, inside=letters)
    codes, distinct = word_codes(TO_LOWER[data], starts, ends)
    return starts, ends, first, codes, [w.decode().lower() for w in distinct.to_pylist()]


def features(texts: pa.Array, learned: dict[str, float]) -> np.ndarray:
    """The dense features of whole texts, in the order of FEATURES; 0 where there is nothing to measure.

    Words are those of words_in(); each distinct word of the slice is looked up once. Rates are by words, or for punctuation and digits by bytes.
    """
    data, offs = byte_view(texts)
    n = len(offs) - 1
    of_letters = letters_in(data)
    starts, ends, first, codes, names = words_in(data, offs, of_letters)
    is_insult = np.array([w in INSULTS for w in names], bool)
    weight = np.array([learned.get(w, 0.0) for w in names], np.float64)
    is_you = np.array([w in SECOND_PERSON for w in names], bool)
    doc = np.repeat(np.arange(n), np.diff(first))
    per = lambda values: np.bincount(doc, values, n) if len(doc) else np.zeros(n)

    def marks(hit: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(hit)])[offs]).astype(np.float64)

    insult, w, you = (is_insult[codes], weight[codes], is_you[codes]) if len(codes) else (np.zeros(0, bool), np.zeros(0), np.zeros(0, bool))
    top = np.zeros(n)
    np.maximum.at(top, doc[w > 0], w[w > 0])
    bad, yours = np.flatnonzero(insult | (w > 0)), np.flatnonzero(you)
    near = np.zeros(len(bad), bool)
    if len(yours):
        for side in (np.searchsorted(yours, bad) - 1, np.searchsorted(yours, bad)):
            other = yours[np.clip(side, 0, len(yours) - 1)]
            near |= (np.abs(other - bad) <= NEAR) & (doc[other] == doc[bad])
    words = np.diff(first).astype(np.float64)
    some, size = np.maximum(words, 1), np.maximum(np.diff(offs), 1)
    letters = np.maximum(marks(of_letters), 1)
    up = UPPER[data]
    inner = offs[1:-1]

    def crossing(k: int) -> np.ndarray:
        """Where the next k bytes are not all of the same text."""
        out = np.zeros(len(data), bool)
        for d in range(1, k + 1):
            out[inner[inner >= d] - d] = True
        return out

    padded = np.concatenate([[False], up, [False, False]])
    before = padded[:-3].copy()
    before[inner[inner < len(data)]] = False
    shouts = marks(~before & up & padded[2:-1] & padded[3:] & ~crossing(2))
    same = np.zeros(len(data) + 3, bool)
    same[: max(0, len(data) - 1)] = data[1:] == data[:-1]
    repeats = marks(same[: len(data)] & same[1 : len(data) + 1] & same[2 : len(data) + 2] & ~crossing(3))
    # words cut by digits or signs, and words spelled out letter by letter
    gap = starts[1:] - ends[:-1]
    cut = np.zeros(len(starts), bool)
    close = np.flatnonzero((gap > 0) & (gap <= 3) & (doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    hiding = np.concatenate([[0], np.cumsum(HIDING[data])])
    cut[close[hiding[starts[close + 1]] - hiding[ends[close]] == gap[close]]] = True
    single = ends - starts == 1
    spelled = np.zeros(len(starts), bool)
    if len(starts) > 3:
        spelled[:-3] = single[:-3] & single[1:-2] & single[2:-1] & single[3:] & (gap[:-2] == 1) & (gap[1:-1] == 1) & (gap[2:] == 1) & (doc[:-3] == doc[3:])
    hidden = np.zeros(n)
    for k in np.flatnonzero(cut | spelled).tolist():
        to = k
        while to + 1 < len(starts) and doc[to + 1] == doc[k] and (cut[to] or (single[to] and single[to + 1] and gap[to] == 1)):
            to += 1
        raw = data[starts[k] : ends[to]].tobytes().decode("utf-8", "replace").lower()
        plain = "".join(c for c in raw.translate(LEET) if c.isalpha())
        hidden[doc[k]] += plain in INSULTS or plain in learned
    columns = [
        per(insult), per(insult) / some, per(w > 0), per(w > 0) / some, per(w), top, np.bincount(doc[bad], near, n) if len(bad) else np.zeros(n), per(you) / some,
        marks(up) / letters, shouts / some, marks(data == 33) / some, marks(data == 63) / some, marks(PUNCTUATION[data]) / size, repeats / some,
        per(cut) / some, per(spelled) / some, hidden, marks(DIGIT[data]) / size, letters / some, np.log1p(words),
    ]
    return np.stack(columns, axis=1)


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds of each feature: quantiles of its distinct values."""
    out = []
    for column in x.T:
        u = np.unique(column)
        cut = (u[1:] + u[:-1]) / 2
        out.append(cut if len(cut) < bins else np.unique(np.quantile(u, np.linspace(0, 1, bins + 1)[1:-1])))
    return out


@dataclass
class Trees:
    """Boosted trees of log-odds: nodes as arrays, children after parents; and the isotonic steps of the probability."""

    base: float
    nodes: list[list[tuple[int, float, int, int, float]]]
    steps: tuple[list[float], list[float]] = ((), ())

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.nodes:
            stack = [(0, np.arange(len(x)))]
            while stack:
                k, rows = stack.pop()
                feature, cut, left, right, value = tree[k]
                if feature < 0:
                    total[rows] += value
                elif len(rows):
                    low = x[rows, feature] <= cut
                    stack += [(left, rows[low]), (right, rows[~low])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        raw = self.odds(x)
        if not len(self.steps[0]):
            return 1 / (1 + np.exp(-raw))
        # the calibrated step, and within it a little of the raw order, so that ranks are not lost to ties
        level = np.interp(raw, self.steps[0], self.steps[1])
        return np.clip(0.995 * level + 0.005 / (1 + np.exp(-raw)), 0.0, 1.0)


def fit_trees(x: np.ndarray, y: np.ndarray, settings: Settings) -> Trees:
    """Second-order boosting of the logistic loss on histograms."""
    mean = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    model = Trees(float(np.log(mean / (1 - mean))), [])
    if len(y) < 10 or y.min() == y.max():
        return model
    cuts = edges(x, settings.bins)
    code = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    width = max(len(c) for c in cuts) + 1
    odds = np.full(len(y), model.base)
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        tree: list[tuple[int, float, int, int, float]] = []
        todo = [(np.arange(len(y)), 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            k = len(tree)
            gs, hs = g[rows].sum(), h[rows].sum()
            value = float(-settings.rate * gs / (hs + 1))
            tree.append((-1, 0.0, 0, 0, value))
            if parent >= 0:
                f, c, a, b, v = tree[parent]
                tree[parent] = (f, c, k, b, v) if side == 0 else (f, c, a, k, v)
            best = (1e-3, -1, 0)
            if depth < settings.depth and hs >= 2 * settings.least_leaf * 0.05 and len(rows) >= 4:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(code[rows, f], g[rows], width))[: len(c)]
                    hl = np.cumsum(np.bincount(code[rows, f], h[rows], width))[: len(c)]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), f, j)
            if best[1] >= 0:
                _, f, j = best
                low = code[rows, f] <= j
                tree[k] = (f, float(cuts[f][j]), 0, 0, value)
                todo += [(rows[~low], depth + 1, k, 1), (rows[low], depth + 1, k, 0)]
            else:
                odds[rows] += value
        model.nodes.append(tree)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators steps of y over raw, as points to interpolate; each step shrunk a little to the middle."""
    if len(raw) < 20 or y.min() == y.max():
        return [], []
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    x: list[float] = []
    p: list[float] = []
    for s, n, lo, hi in blocks:
        level = (s + 0.5) / (n + 1)
        if p:
            level = max(level, p[-1])
        for at in (lo, hi) if hi > lo else (lo,):
            x.append(at)
            p.append(level)
    return x, p


def fold(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[dict[str, float], Trees]:
    """The learned lexicon and the trees, from labelled rows outside the held-out fold.

    Rows of folds 1 and 2 (crc32 of the id mod 5) give the lexicon, those of 3 and 4 the trees and, a quarter of them, the
    calibration, so that the trees see the lexicon as it does on new texts, and the steps see the trees so.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumnRenamed("doc_id", "__id")
    known = materialize(known.withColumn("fold", fold(F.col("__id")) % 5).where("fold != 0"))
    lexicon, trees = F.col("fold") <= 2, F.col("fold") >= 3
    sizes = known.agg(F.count_if(lexicon).alias("a"), F.count_if(trees).alias("b")).first()
    # a share of the rows by hash, so that no task sorts them all; all rows while they are within the bound
    drawn = lambda most, n: F.pmod(F.xxhash64("__id", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, n)))
    chosen = known.where((lexicon & drawn(settings.lexicon_rows, sizes["a"])) | (trees & drawn(settings.fit_rows, sizes["b"])))
    drawn_rows = min(sizes["a"], settings.lexicon_rows) + min(sizes["b"], settings.fit_rows)
    if drawn_rows <= BROADCAST_ROWS:  # with other settings the join is left to the optimizer
        chosen = F.broadcast(chosen)
    rows = materialize(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic", "fold"))
    train = rows.where("fold <= 2")
    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    seen = distinct_words(train).groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    least = max(1, min(settings.word_rows, pos // 50 + 1))
    odds = F.log((F.col("p") + 0.1) / (pos + 0.2)) - F.log((F.col("n") + 0.1) / (neg + 0.2))
    chosen = seen.where(F.col("p") >= least).withColumn("odds", odds).where(F.col("odds") >= np.log(settings.odds))
    top = chosen.orderBy(F.col("p") * F.col("odds"), "w", ascending=[False, True]).limit(settings.lexicon_words).collect() if pos and neg else []
    learned = {r["w"]: float(r["odds"]) for r in top}
    held = (F.pmod(F.xxhash64("doc_id", F.lit("steps")), F.lit(4)) == 0).alias("held")
    table = measured(rows.where("fold >= 3").select("text", "toxic", held), learned, ["toxic", "held"]).toPandas()
    x = np.array(table["x"].tolist(), np.float64).reshape(len(table), len(FEATURES))
    y, held = table["toxic"].to_numpy(np.float64), table["held"].to_numpy(bool)
    # the isotonic steps are those of the trees that are used, from rows that they have not seen
    model = fit_trees(x[~held], y[~held], settings)
    model.steps = isotonic(model.odds(x[held]), y[held])
    return learned, model


def distinct_words(rows: DataFrame) -> DataFrame:
    """(toxic, w): a row for each row of rows (text, toxic) and word in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = byte_view(part.column("text"))
                _, _, first, codes, names = words_in(data, offs, letters_in(data))
                # words that agree in lower case beyond ASCII are one
                plain = pa.array(names, pa.string()).dictionary_encode()
                one = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                n = max(1, len(plain.dictionary))
                own = np.unique(np.repeat(np.arange(part.num_rows), np.diff(first)) * n + (one[codes] if len(codes) else codes))
                yield pa.RecordBatch.from_arrays([part.column("toxic").take(pa.array(own // n)), plain.dictionary.take(pa.array(own % n))], names=["toxic", "w"])

    kind = rows.schema["toxic"].dataType.simpleString()
    return texts(rows, "toxic", "text").mapInArrow(bounded(run), f"toxic {kind}, w string")


def measured(rows: DataFrame, learned: dict[str, float], keep: list[str]) -> DataFrame:
    """keep and x (the features) for each row."""
    schema = rows.select(*keep).schema.add("x", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"), learned)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(x.tolist(), pa.list_(pa.float64()))], names=[*keep, "x"])

    return texts(rows, *dict.fromkeys([*keep, "text"])).mapInArrow(bounded(run), schema)


def scored(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels: doc_id, toxic.

    Null or empty text: the score of a text without features. Null doc_id: scored, held out as the empty id is.
    Repeated rows each give a row; an id with several labels counts as toxic if one says so. Without labels of both
    kinds every text has the share of toxic ones as score. Empty docs: no rows. Other columns are not read.
    """
    settings = settings or Settings()
    learned, model = learn(docs, labels, settings)
    shared = docs.sparkSession.sparkContext.broadcast((learned, model))  # bounded by lexicon_words and trees * 2 ** depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, trees = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(trees.score(features(part.column("text"), words)))], names=["doc_id", "score"])

    out = texts(docs, "doc_id", "text").mapInArrow(bounded(run), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
