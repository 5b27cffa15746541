"""Near copies of embeddings by cosine: an inverted multi-index finds candidates, each is verified in double precision.

A vector of length one is cut into halves; each half has a codebook of its own, and a pair of codewords is a
cell of the product grid. A vector visits cells in the order of the sum of its squared distances to the two codewords
(multi-sequence order). How many it visits is calibrated: partners at exactly the threshold are made for a
sample, and the depth is the one at which ``recall`` of them are found by one side or the other. Neighbouring
cells form blocks of about ``BLOCK_ROWS`` vectors, and all vectors of a visited block are compared.

Codebooks are fitted to at most ``SAMPLE`` vectors, chosen by digest; every vector is placed and every
vector visits. Equal vectors are one weighted node. A block's visitors and its vectors meet in slices of at most
``SLICE_ROWS`` rows, so a heavy cell becomes many tasks. A task returns a count per vector and the tree of
components it saw, never pairs: a pair seen from both sides is counted on each side once, a pair seen from one side is counted
for both vectors there, since a vector carries the list of blocks that it visits.

Nulls and odd rows: vectors that are null, empty, all zero or hold a null or non-finite entry link with
nothing and name their own component. Vectors link with vectors of their length only; each length has an index of its own.
Repeated ids stay rows; a component's name is its smallest id that is not null. Ties and repeats need no rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.components import connected_components
from tabloom.operators.ranking import global_row_number
from tabloom.session import broadcast_if_small, cut_lineage

SAMPLE = 32_768
MAX_CODEWORDS = 512
CELL_ROWS, BLOCK_ROWS, SLICE_ROWS = 64, 1_024, 16_384
CELLS_AT_ONCE = 2_000_000


def unit(column: pa.Array, d: int) -> np.ndarray:
    """Rows of length one in double precision."""
    m = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    m = m / np.abs(m).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)  # squares neither overflow nor vanish
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] - 2 * a @ b.T + np.einsum("ij,ij->i", b, b), 0.0)


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's means of ``points``, with codewords that resemble each other next to each other."""
    r = np.random.default_rng(42)
    words = points[r.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = squared(points, words).argmin(axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    order, left = [0], set(range(1, k))
    while left:  # a walk from each codeword to the nearest one left; k is at most MAX_CODEWORDS
        rest = sorted(left)
        order.append(rest[int(squared(words[order[-1:]], words[rest])[0].argmin())])
        left.remove(order[-1])
    return words[order]


@dataclass
class MultiIndex:
    """Two codebooks, the number of cells that a vector visits, and the edge of a block in cells."""

    words: tuple[np.ndarray, np.ndarray]
    depth: int
    edge: int

    @property
    def k(self) -> int:
        return len(self.words[0])

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = rows.shape[1] // 2
        return squared(rows[:, :half], self.words[0]), squared(rows[:, half:], self.words[1])

    def block(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return i // self.edge * -(-self.k // self.edge) + j // self.edge

    def ranks(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many cells come before the cell (i, j) in the order of each row."""
        a, b = self.distances(rows)
        at = np.arange(len(rows))
        limit = a[at, i] + b[at, j]
        b = np.sort(b, axis=1)
        return np.array([np.searchsorted(b[r], limit[r] - a[r], side="left").sum() for r in at])

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home block of every row, and the sorted blocks it visits."""
        a, b = self.distances(rows)
        homes = self.block(a.argmin(axis=1), b.argmin(axis=1))
        depth = min(self.depth, self.k**2)
        # The cell that is i-th in one half and j-th in the other has (i + 1)(j + 1) - 1 cells before it.
        i, j = np.nonzero(np.multiply.outer(np.arange(1, self.k + 1), np.arange(1, self.k + 1)) <= depth)
        visits, step = [], max(1, CELLS_AT_ONCE // len(i))
        for s in range(0, len(rows), step):
            x, y = np.argsort(a[s:s + step], axis=1, kind="stable"), np.argsort(b[s:s + step], axis=1, kind="stable")
            total = np.take_along_axis(a[s:s + step], x, 1)[:, i] + np.take_along_axis(b[s:s + step], y, 1)[:, j]
            first = np.argpartition(total, depth - 1, axis=1)[:, :depth]
            blocks = self.block(np.take_along_axis(x, i[first], 1), np.take_along_axis(y, j[first], 1))
            visits += [np.unique(row) for row in blocks]
        return homes, visits


def fit(sample: np.ndarray, n: int, threshold: float, recall: float) -> MultiIndex:
    """Codebooks for ``n`` vectors from the rows of ``sample`` (of length one), and the calibrated depth."""
    k = int(np.clip(round((n / CELL_ROWS) ** 0.5), 1, min(MAX_CODEWORDS, len(sample))))
    half = sample.shape[1] // 2
    edge = int(np.ceil(k * (BLOCK_ROWS / max(n, 1)) ** 0.5))
    index = MultiIndex((codebook(sample[:, :half], k), codebook(sample[:, half:], k)), k**2, min(max(edge, 1), k))
    r = np.random.default_rng(7)
    x = sample[r.permutation(len(sample))[:4_096]]
    found = []
    for towards in (r.normal(size=x.shape), np.roll(x, 1, axis=0)):  # a random direction; that of another vector
        away = towards - np.einsum("ij,ij->i", towards, x)[:, None] * x
        size = np.linalg.norm(away, axis=1)
        some = size > 1e-9
        y = threshold * x[some] + (1 - threshold**2) ** 0.5 * away[some] / size[some, None]
        ends = [(u, *(d.argmin(axis=1) for d in index.distances(v))) for u, v in ((x[some], y), (y, x[some]))]
        found.append(np.minimum(*(index.ranks(*end) for end in ends)))
    ranks = np.concatenate(found)
    index.depth = int(np.quantile(ranks, recall, method="higher")) + 1 if len(ranks) else 1
    return index


def _place(nodes: DataFrame, index: MultiIndex, d: int) -> DataFrame:
    """``nodes`` with ``home`` and ``visits``."""
    shared = nodes.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            homes, visits = shared.value.place(unit(batch.column("v"), d))
            ends = np.cumsum([0] + [len(v) for v in visits]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(visits).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes.astype(np.int32)), lists], [*batch.schema.names, "home", "visits"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(run, f"{fields}, home int, visits array<int>")


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i]; ``parent`` names the smallest member of every set before and after."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _meet(d: int, threshold: float):
    """Verify the visitors of a block slice against its vectors: (node, n, to) with weighted counts and a tree of components."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def work(q: pa.Table, b: pa.Table) -> pa.Table:
        if not len(q) or not len(b):
            return schema.empty_table()
        q, b = q.combine_chunks(), b.combine_chunks()
        get = lambda t, c: t.column(c).combine_chunks()
        qm, bm = unit(get(q, "v"), d), unit(get(b, "v"), d)
        qn, bn, qw, bw = (np.asarray(x) for x in (q.column("node"), b.column("node"), q.column("w"), b.column("w")))
        homes, at = np.unique(np.asarray(q.column("home")), return_inverse=True)
        lists = get(b, "visits")
        owner, flat = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        back = np.zeros((len(b), len(homes)), bool)  # does the vector visit that home itself?
        there = np.isin(flat, homes)
        back[owner[there], np.searchsorted(homes, flat[there])] = True
        counts, parent = np.zeros(len(q) + len(b), np.int64), np.arange(len(q) + len(b))
        step = max(1, CELLS_AT_ONCE // len(b))
        for s in range(0, len(q), step):
            near = qm[s:s + step] @ bm.T >= threshold
            near &= qn[s:s + step, None] != bn[None, :]
            i, j = np.nonzero(near)
            np.add.at(counts, i + s, bw[j])
            alone = ~back[j, at[i + s]]
            np.add.at(counts, len(q) + j[alone], qw[i[alone] + s])
            _hook(parent, i + s, len(q) + j)
        nodes = np.concatenate([qn, bn])
        linked = (counts > 0) | (parent != np.arange(len(parent)))
        return pa.table([nodes[linked], counts[linked], nodes[parent[linked]]], schema=schema)

    return work


def _links(nodes: DataFrame, d: int, threshold: float, recall: float) -> DataFrame:
    """(node, n, to) of the vectors of length ``d``."""
    n = nodes.count()
    sample = nodes.orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()  # SAMPLE vectors at most
    index = fit(unit(sample, d), n, threshold, recall)
    placed = cut_lineage(_place(nodes.select("node", "v", "w"), index, d))
    slices = lambda c: F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias(c)
    base = placed.groupBy(F.col("home").alias("block")).agg(slices("nb"))
    blocks = cut_lineage(placed.select(F.explode("visits").alias("block")).groupBy("block").agg(slices("nq")).join(base, "block"))
    blocks = broadcast_if_small(blocks)  # MAX_CODEWORDS squared blocks at most
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    slot = lambda seed, c: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
    probes = placed.select("node", "v", "w", "home", F.explode("visits").alias("block")).join(blocks, "block")
    probes = probes.withColumn("qs", slot(1, "nq")).withColumn("bs", upto("nb")).drop("nq", "nb")
    stored = placed.select(*[F.col(c).alias(c) for c in ("node", "v", "w", "visits")], F.col("home").alias("block")).join(blocks, "block")
    stored = stored.withColumn("bs", slot(2, "nb")).withColumn("qs", upto("nq")).drop("nq", "nb")
    keys = ("block", "qs", "bs")
    return probes.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(_meet(d, threshold), "node bigint, n bigint, to bigint")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.9995) -> DataFrame:
    """(key, n_links, component_id, kept) per row: vectors linked directly, smallest id reachable, whether that is the row's own."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    valid = v.isNotNull() & F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = df.select(F.col(key).alias("id"), F.when(valid, v).alias("v"))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))
    nodes = rows.where("v IS NOT NULL").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("first"), F.count(F.lit(1)).alias("w"))
    nodes = cut_lineage(global_row_number(nodes, [F.col("first").asc_nulls_last(), F.col("h1"), F.col("h2")], "node"))  # node order is id order

    lengths = [r["d"] for r in nodes.select(F.size("v").alias("d")).distinct().collect()]
    found = [_links(nodes.where(F.size("v") == d), d, threshold, recall) for d in lengths]
    counted = nodes.select("h1", "h2", "first", "node", "w")
    if found:
        found = cut_lineage(reduce(DataFrame.unionByName, found))
        comps = connected_components(found.select(F.col("node").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "_node")
        totals = found.groupBy(F.col("node").alias("_n")).agg(F.sum("n").alias("n"))
        counted = counted.join(comps, F.col("node") == F.col("_node"), "left").join(totals, F.col("node") == F.col("_n"), "left")
        counted = counted.withColumn("component", F.coalesce("component", "node"))
        names = counted.groupBy("component").agg(F.min("first").alias("name"))
        counted = cut_lineage(counted.join(names, "component").select("h1", "h2", "name", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n")))
    else:
        counted = counted.select("h1", "h2", F.col("first").alias("name"), F.lit(0).cast("bigint").alias("n"))
    lone, linked = rows.where("h1 IS NULL"), rows.where("h1 IS NOT NULL").select("id", "h1", "h2").join(counted, ["h1", "h2"])
    out = linked.select("id", F.col("n").alias("n_links"), F.col("name").alias("component_id"))
    out = out.unionByName(lone.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
