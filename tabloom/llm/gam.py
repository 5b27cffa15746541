"""Quality classifier: a generalised additive model with pairwise interactions.

Texts are described by the measurements in FEATURES. Each is cut into bins at quantiles of the
training rows. Boosting goes round the features: in each round every feature in turn gets a small
tree over its bins, fitted to the current gradients, and a part of the tree is added to the feature's
look-up table. Then the pairs of features whose two-dimensional tables would explain most of the
remaining gradients get tables of their own in the same way. A text's score is the logistic function
of the sum of its table entries.

Training takes at most about ``sample`` labelled rows (a documented bound; which ones follows from
hashes of the whole rows, repeated rows counting once) and whole texts. Scoring covers every row.

Nulls and empties: a null text counts as empty and is scored like any other. Rows without a label, or
whose id has no document, do not train. Without training rows, or with one label only, the score is
the smoothed share of label 1. Repeated rows and ids give a row each.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.blocks import as_bytes, keep_rows, map_blocks, texts_of
from tabloom.llm.textstats import Flat, repeated_windows, table_of
from tabloom.session import cut_lineage

SAMPLE = 20_000  # labelled rows to learn from
BINS = 32
PAIR_BINS = 8
ROUNDS, PAIR_ROUNDS = 200, 60
PAIRS = 6
RATE = 0.1
RIDGE = 1.0  # added to the second derivatives of a leaf
THRESHOLD = 0.3

FEATURES = ["log_words", "word_length", "symbols", "bars", "upper", "shouts", "digits", "points", "not_ascii", "duplicate_lines",
            "words_per_line", "repeated_windows", "distinct_words", "most_common"]
CLASSES = {
    "symbols": table_of("#*$%&|<>"), "bars": table_of("|"), "upper": table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "shouts": table_of("!"),
    "digits": table_of("0123456789"), "points": table_of(".,;:?"), "not_ascii": np.arange(256) >= 0xC0,
}


def features(texts: list[bytes]) -> np.ndarray:
    """(text, feature); whole texts, counted on the bytes of the block."""
    flat = Flat(texts)
    n_words, chars = flat.words()
    words, letters = np.maximum(n_words, 1), np.maximum(chars, 1)
    split = [t.split() for t in texts]
    lines = [[x for x in t.split(b"\n") if x.strip(b" \t\n\v\f\r")] for t in texts]
    n_lines = np.maximum([len(x) for x in lines], 1)
    distinct_lines = np.array([len(set(x)) for x in lines])
    counts = [Counter(s) for s in split]
    distinct = np.array([len(c) for c in counts])
    commonest = np.array([max(c.values(), default=0) for c in counts])
    per = {name: flat.total(table[flat.data]) for name, table in CLASSES.items()}
    columns = {
        "log_words": np.log2(n_words + 1), "word_length": chars / words, "symbols": per["symbols"] / words, "bars": per["bars"] / words,
        "upper": per["upper"] / letters, "shouts": per["shouts"] / words, "digits": per["digits"] / letters, "points": per["points"] / words,
        "not_ascii": per["not_ascii"] / letters, "duplicate_lines": (n_lines - np.maximum(distinct_lines, 1)) / n_lines,
        "words_per_line": np.log2(n_words / n_lines + 1), "repeated_windows": repeated_windows(split) / words,
        "distinct_words": distinct / words, "most_common": commonest / words,
    }
    return np.column_stack([columns[f] for f in FEATURES]).astype(float)


@dataclass
class Model:
    """Intercept, bin edges, one table per feature, and tables of pairs with their coarse edges."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        for (i, j), table in self.pairs.items():
            total += table[at[i], at[j]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of ordered bins with gradient and curvature sums."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def small_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values per bin of a tree that cuts the ordered bins into at most ``leaves`` ranges, greedily."""
    ranges = [(0, len(g))]
    while len(ranges) < leaves:
        found = [(*best_split(g[a:b], h[a:b]), a, b) for a, b in ranges]
        gain, cut, a, b = max(found, key=lambda f: f[0])
        if gain <= 1e-9:
            break
        ranges.remove((a, b))
        ranges += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, table) of the best cut of both features of a pair into four quarters."""
    best, table = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    whole = g.sum() ** 2 / (h.sum() + RIDGE)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            q = [(cg[a - 1, b - 1], ch[a - 1, b - 1])]
            q.append((cg[a - 1, -1] - q[0][0], ch[a - 1, -1] - q[0][1]))
            q.append((cg[-1, b - 1] - q[0][0], ch[-1, b - 1] - q[0][1]))
            q.append((cg[-1, -1] - sum(v for v, _ in q), ch[-1, -1] - sum(v for _, v in q)))
            gain = sum(v * v / (w + RIDGE) for v, w in q) - whole
            if gain > best:
                best, table = gain, np.empty_like(g)
                leaf = [v / (w + RIDGE) for v, w in q]
                table[:a, :b], table[:a, b:], table[a:, :b], table[a:, b:] = leaf
    return best, table


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the logistic loss, first the features, then the chosen pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or len(np.unique(y)) < 2:
        return model
    model.edges = [quantile_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.coarse = [quantile_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, bins in enumerate(at):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * small_tree(np.bincount(bins, g, size), np.bincount(bins, h, size))
            model.tables[j] += step
            total += step[bins]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        flat, g_h = wide[i] * shape[1] + wide[j], slopes()
        return tuple(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in g_h)

    gains = sorted(((pair_tree(*sums(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for gain, i, j in gains[:PAIRS] if gain > 0}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            step = RATE * pair_tree(*sums(i, j))[1]
            table += step
            total += step[wide[i], wide[j]]
    return model


def held_out() -> Column:
    """A fifth of the documents, by a checksum of their id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, quality and an array of the features of every text."""
    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            x = features(as_bytes(block.column("text")))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            return pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("quality"), values], ["doc_id", "quality", "x"])

        return work

    return map_blocks(texts_of(docs, "doc_id", "quality"), make, "doc_id bigint, quality int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn ``labels`` (doc_id, quality) on ``docs``, without the documents that are held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int")).distinct()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"))
    # Repeats count once, and digests place rows, so no id can bring more than its share.
    labelled = cut_lineage(rows.drop("text").distinct().join(known, "doc_id"))
    place = F.pmod(F.xxhash64("doc_id", "d1", "d2", "quality"), F.lit(1_000_000)) / 1_000_000.0
    chosen = cut_lineage(labelled.where(place < sample / max(labelled.count(), 1)))  # about ``sample`` rows, so small enough to send to every task
    texts = rows.join(F.broadcast(chosen.select("doc_id", "d1", "d2").distinct()), ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    table = measured(texts.join(F.broadcast(chosen), ["doc_id", "d1", "d2"])).orderBy("doc_id", "quality", "x").toArrow()
    x = np.array(table["x"].to_pylist(), dtype=float).reshape(len(table), len(FEATURES))
    return fit(x, (table["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            value = model.score(features(as_bytes(block.column("text"))))
            return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(value)], ["doc_id", "score"])

        return work

    return map_blocks(texts_of(docs, "doc_id"), make, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    scored = score(docs, train(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a score of at least the threshold."""
    model = train(docs, labels)
    return keep_rows(docs, lambda: lambda block: model.score(features(as_bytes(block.column("text")))) >= THRESHOLD)
