"""Principal components with centring and fixed signs, of dense vectors and of long sparse ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.functions.scalars import preview
from tabloom.operators.clean import scale_for_clustering
from tabloom.operators.relational import running_total
from tabloom.session import cut_lineage

MAX_DIMENSIONS = 4_096  # the covariance matrix is d x d on the driver
MAX_BLOCK = 8_000_000  # terms times block width of sparse components: numbers broadcast in a round
MAX_BASIS = 32_000_000  # terms times basis width, on the driver; a wider basis is restarted from its best vectors
PIECE = 4_000_000  # numbers that a task multiplies at a time


@dataclass
class PcaFit:
    """Small artefacts: means, a d x k matrix whose largest loading per component is positive, variance shares."""

    means: list[float]
    loadings: list[list[float]]
    shares: list[float]
    features: list[str]

    def explained(self, spark) -> DataFrame:
        rows = [(i + 1, round(s * 100, 2)) for i, s in enumerate(self.shares)]
        return running_total(spark.createDataFrame(rows, "component int, explained_pct double"), "component", "explained_pct", "cumulative_pct")

    def loading_table(self, spark) -> DataFrame:
        rows = [(f, *[float(x) for x in row]) for f, row in zip(self.features, self.loadings)]
        names = ", ".join(f"pc{i + 1} double" for i in range(len(self.shares)))
        return spark.createDataFrame(rows, f"feature string, {names}")

    def transform(self, df: DataFrame, vector: str) -> DataFrame:
        """Adds pc1..pck: centred values times the loadings, as column expressions."""
        means = F.array(*[F.lit(float(m)) for m in self.means])
        centred = F.zip_with(col(vector).cast("array<double>"), means, lambda a, m: a - m)
        df = df.withColumn("_centred", centred)
        out = {}
        for j in range(len(self.shares)):
            weights = F.array(*[F.lit(float(row[j])) for row in self.loadings])
            out[f"pc{j + 1}"] = F.aggregate(F.zip_with("_centred", weights, lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x)
        return df.withColumns(out).drop("_centred")


def fit_pca(df: DataFrame, vector: str, dims: int, k: int, features: list[str] | None = None) -> PcaFit:
    if dims > MAX_DIMENSIONS:
        raise ValueError(f"{dims} dimensions: reduce the features to at most {MAX_DIMENSIONS} first")
    v = col(vector).cast("array<double>")
    row = df.agg(*[F.avg(v[i]).alias(f"m{i}") for i in range(dims)]).first()
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(df.select(array_to_vector(v).alias("_f")))
    pc = _signed(model.pc.toArray())
    return PcaFit([float(row[i]) for i in range(dims)], pc.tolist(), [float(x) for x in model.explainedVariance], features or [f"x{i}" for i in range(dims)])


def _signed(pc: np.ndarray) -> np.ndarray:
    """Components whose largest loading is positive; of equally large ones the first counts."""
    size = np.abs(pc)
    lead = (size >= size.max(axis=0) * (1 - 1e-6)).argmax(axis=0)
    return pc * np.sign(pc[lead, np.arange(pc.shape[1])])


def pca_columns(df: DataFrame, key: str, cols: list[str], k: int, missing_rule: str = "mean") -> tuple[DataFrame, PcaFit]:
    """Fill, standardise, project: (key, pc1..pck) and the fit."""
    scaled, _ = scale_for_clustering(df, cols, missing_rule)
    data = scaled.select(key, F.array(*[col(c).cast("double") for c in cols]).alias("_v"))
    fit = fit_pca(data, "_v", len(cols), k, cols)
    return fit.transform(data, "_v").drop("_v"), fit


def projection_rows(vectors: DataFrame, corpus: DataFrame, dims: int, k: int = 2, key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """2-D or 3-D coordinates of documents with source and an 80-character preview; not standardised."""
    data = vectors.select(key, col(vector).alias("_v"))
    coords = fit_pca(data, "_v", dims, k).transform(data, "_v").drop("_v")
    return coords.join(corpus.select(key, "source", preview("text", 80).alias("preview")), key)


# ---- long sparse rows --------------------------------------------------------------------------------------

def sparse_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, indices, weights) of long rows (doc_id, index, weight), stored; a row is as long as its terms are many."""
    rows = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", F.col("weight").cast("double").alias("weight")))).alias("c"))
    return cut_lineage(rows.select("doc_id", F.col("c.index").cast("array<int>").alias("indices"), F.col("c.weight").alias("weights")))


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row count, row of each cell, index, weight) of runs of rows with about PIECE / width cells. No row is empty."""
    lists = batch.column("indices")
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    index, weight = lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
    most, start = max(1, PIECE // width), 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        cells = slice(ends[start], ends[stop])
        yield start, stop - start, np.repeat(np.arange(stop - start), np.diff(ends[start:stop + 1])), index[cells], weight[cells]
        start = stop


def _row_products(row: np.ndarray, index: np.ndarray, weight: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weight[:, None] * block[index], np.flatnonzero(np.diff(row, prepend=-1)))


def _listed(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())


def _sums_of_index(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    index, values = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(index, kind="stable")
    index = index[order]
    starts = np.flatnonzero(np.diff(index, prepend=-1))
    return index[starts], np.add.reduceat(values[order], starts)


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """X'X times ``block`` (terms x width) for stored ``rows``: each task adds up its rows, then sums meet by term."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    width = block.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total, met = np.zeros_like(block), np.zeros(len(block), bool)
        for batch in batches:
            for _, _, row, index, weight in _pieces(batch, width):
                found, sums = _sums_of_index([(index, weight[:, None] * _row_products(row, index, weight, block)[row])])
                total[found] += sums
                met[found] = True
        found = np.flatnonzero(met).astype(np.int32)
        for at in range(0, len(found), 1000):
            some = found[at:at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(some), _listed(total[some])], ["index", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            if batch.num_rows:
                new = (batch.column("index").to_numpy(), batch.column("sums").flatten().to_numpy().reshape(-1, width))
                have = _sums_of_index([new] if have is None else [have, new])
        if have is not None:
            yield pa.RecordBatch.from_arrays([pa.array(have[0]), _listed(have[1])], ["index", "sums"])

    schema = "index int, sums array<double>"
    out = np.zeros_like(block)
    for r in rows.mapInArrow(partial, schema).repartition("index").mapInArrow(added, schema).toLocalIterator():  # one row per term
        out[r["index"]] = r["sums"]
    shared.destroy()
    return out


def _new_directions(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``block`` has outside ``basis``."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-12 * max(s.max(initial=0.0), 1e-300)]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0]


def fit_sparse_pca(rows: DataFrame, n_docs: int, size: int, k: int, oversample: int = 8, rounds: int = 40, tolerance: float = 1e-6,
                   seed: int = 42, features: list[str] | None = None) -> PcaFit:
    """Components of ``n_docs`` sparse rows over ``size`` terms (``sparse_rows``; documents without terms count as zero rows).

    Randomised block subspace iteration that keeps earlier blocks: a round multiplies a block of k + ``oversample``
    directions by the covariance, in one scan of the stored rows, and the best vectors of all directions so far are
    taken. Rows are centred by what the mean adds to the product, so they stay sparse. The next block holds what the
    best vectors leave over; rounds end when that is at most ``tolerance`` of the largest eigenvalue for the k components.
    Fewer components are returned where the rows have no more.
    """
    width = min(k + oversample, size)
    if size * width > MAX_BLOCK:
        raise ValueError(f"{size} terms times {width} directions: at most {MAX_BLOCK} numbers; take fewer terms or components")
    if n_docs < 2:
        raise ValueError("components need two rows")
    sums = rows.select(F.explode(F.arrays_zip("indices", "weights")).alias("c")).groupBy(F.col("c.indices").alias("i"))
    mean, squares = np.zeros(size), 0.0
    for r in sums.agg(F.sum("c.weights").alias("s"), F.sum(F.col("c.weights") * F.col("c.weights")).alias("q")).toLocalIterator():  # one row per term
        mean[r["i"]], squares = r["s"] / n_docs, squares + r["q"]
    total = (squares - n_docs * float(mean @ mean)) / (n_docs - 1)
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    values, vectors = np.zeros(0), np.zeros((size, 0))
    for _ in range(rounds):
        product = (gram_times(rows, block) - n_docs * np.outer(mean, mean @ block)) / (n_docs - 1)
        basis, image = np.hstack([basis, block]), np.hstack([image, product])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        vectors, pushed = basis @ turn, image @ turn
        rest = pushed - vectors * values
        left = np.linalg.norm(rest, axis=0)
        top = max(values[0], 1e-300)
        if left[:k].max() <= tolerance * top:
            break
        if size * (basis.shape[1] + width) > max(MAX_BASIS, 3 * size * width):
            basis, image = vectors, pushed
        block = _new_directions(rest[:, left > 0.1 * tolerance * top], basis)
        if not block.shape[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    kept = values[:k] > 1e-12 * max(values[0], 1e-300)
    shares = [float(v / total) for v in values[:k][kept]]
    return PcaFit(mean.tolist(), _signed(vectors[:, :k][:, kept]).tolist(), shares, features or [f"x{i}" for i in range(size)])


def sparse_scores(rows: DataFrame, docs: DataFrame, fit: PcaFit, key: str = "doc_id") -> DataFrame:
    """(key, pc1..pck) of every row of ``docs``; those without terms lie where the zero row does."""
    loadings = np.array(fit.loadings)
    k = loadings.shape[1]
    origin = -(np.array(fit.means) @ loadings)
    shared = rows.sparkSession.sparkContext.broadcast(loadings)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, index, weight in _pieces(batch, k):
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(first, n), _listed(_row_products(row, index, weight, shared.value) + origin)], ["_key", "_s"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.withColumnRenamed("doc_id", "_key").mapInArrow(project, f"_key {kind}, _s array<double>")
    joined = docs.select(key).join(scored, F.col(key) == F.col("_key"), "left")
    return joined.select(key, *[F.coalesce(F.col("_s")[j], F.lit(float(origin[j]))).alias(f"pc{j + 1}") for j in range(k)])


def sparse_projection_rows(cells: DataFrame, corpus: DataFrame, size: int, k: int = 2, key: str = "doc_id") -> DataFrame:
    """``projection_rows`` for long rows (doc_id, index, weight) over ``size`` terms, such as TF-IDF weights."""
    rows = sparse_rows(cells)
    fit = fit_sparse_pca(rows, corpus.count(), size, k)
    about = corpus.select(key, "source", preview("text", 80).alias("preview"))
    return sparse_scores(rows, corpus, fit, key).join(about, key)
