"""Exact neighbours without forming pairs.

Queries and base rows meet in blocks of bounded size, where numpy works on slices; only the reduced
answer per query (k best rows, a count, a sum per cluster) leaves a task. Larger inputs are dealt to the
leaves of a pivot tree first: by the triangle inequality a query visits only the leaves that reach into its
ball. For the k nearest, the ball shrinks from round to round: the closest leaf, a few more, then what is
still in reach. Leaves are split by a hash of the id, so a heavy one becomes many even blocks. Nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import cut_lineage

BLOCK_ROWS = 20_000
FAN_OUT, LEAF_ROWS = 256, 500
PIVOT_CELLS = 4_000_000  # numbers of all pivots together: 32 MB
ROUNDS = (1, 4)  # leaves visited before the last round, closest first
SLICE_CELLS = 4_000_000  # distance cells held at once inside a task


def vectorised(df: DataFrame, cols: list[str], key: str, payload: str | None = None) -> DataFrame:
    """(id, v array<double>[, payload])."""
    from tabloom.functions.columns import col

    vec = F.array(*[col(c).cast("double") for c in cols])
    return df.select(col(key).alias("id"), vec.alias("v"), *([col(payload).alias("payload")] if payload else []))


def _blocks(n: int, rows: int, floor: int = 1) -> int:
    return max(floor, -(-n // rows))


def blockwise(
    queries: DataFrame, base: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    block_rows: int = BLOCK_ROWS, eps: float | None = None,
) -> DataFrame:
    """``work(query block, base block)`` for all blocks that may meet; both sides have a unique ``id``.

    With ``eps`` and more base rows than one block holds, a query visits only the leaves of a pivot tree that reach
    into its ball; otherwise every query block meets every base block.
    """
    base = base.select(*[F.col(c).alias(c) for c in base.columns])  # both sides may stem from one table
    nq, nb = queries.count(), base.count()
    if nb > block_rows and eps is not None:
        tree, placed = plant(base, nb)
        sent = _sent(queries.withColumn("_reach", F.lit(float(eps))).withColumn("_done", F.lit(0.0)), tree)
        return _at_leaves(sent, placed, tree, work, schema, block_rows)
    cores = max(1, min(queries.sparkSession.sparkContext.defaultParallelism, nq // 256))
    bq, bb = _blocks(nq, block_rows, cores), _blocks(nb, block_rows)
    q = queries.withColumn("_q", _slice_of(F.lit(bq))).withColumn("_b", F.explode(_upto(F.lit(bb))))
    b = base.withColumn("_b", _slice_of(F.lit(bb))).withColumn("_q", F.explode(_upto(F.lit(bq))))
    return q.groupBy("_q", "_b").cogroup(b.groupBy("_q", "_b")).applyInPandas(work, schema)


def _slice_of(parts):
    return F.pmod(F.xxhash64("id"), parts.cast("bigint"))


def _upto(parts):
    return F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)


class PivotTree:
    """Two levels of pivots over the base rows, with the radius and the row count of every node.

    At most ``FAN_OUT`` pivots stand at the top, each with at most ``FAN_OUT`` leaves below; all pivots together hold at most
    ``PIVOT_CELLS`` numbers, which is what travels to the tasks. Pivots are means of a sample; radii and counts are those of
    all rows, so a node is ruled out only where the triangle inequality says so.
    """

    def __init__(self, tops: np.ndarray, leaves: list[np.ndarray]):
        self.tops, self.leaves = tops, np.vstack(leaves)
        self.first = np.cumsum([0] + [len(x) for x in leaves])
        self.top_radius = np.zeros(len(tops))
        self.radius, self.rows = np.zeros(len(self.leaves)), np.zeros(len(self.leaves), np.int64)

    @staticmethod
    def wanted(nb: int, dims: int) -> int:
        return max(1, min(nb // LEAF_ROWS, FAN_OUT * FAN_OUT, PIVOT_CELLS // max(1, dims)))

    @classmethod
    def of(cls, sample: np.ndarray, count: int) -> PivotTree:
        tops = _means(sample, min(FAN_OUT, max(1, round(count**0.5))))
        owner = _distances(sample, tops).argmin(axis=1)
        parts = [sample[owner == t] if (owner == t).any() else tops[t:t + 1] for t in range(len(tops))]
        share = [min(FAN_OUT, max(1, round(count * len(x) / len(sample)))) for x in parts]
        return cls(tops, [_means(x, min(n, len(x))) for x, n in zip(parts, share)])

    def place(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to it, distance to the top pivot) per row."""
        top = _distances(m, self.tops).argmin(axis=1)
        leaf = np.empty(len(m), np.int64)
        for t in np.unique(top).tolist():
            rows = np.flatnonzero(top == t)
            leaf[rows] = self.first[t] + _distances(m[rows], self.leaves[self.first[t]:self.first[t + 1]]).argmin(axis=1)
        exact = lambda p: np.sqrt(((m - p) ** 2).sum(axis=1))
        return leaf, exact(self.leaves[leaf]), exact(self.tops[top])

    def visits(self, m: np.ndarray, reach: np.ndarray, k: int | None, done: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(leaves, distances) in rising distance per row: all that may hold a row within ``reach``; with ``k``, of the k nearest.

        Leaves at less than ``done`` were visited before. One at that very distance may come again.
        """
        at, near, away = [], [], []
        slack = 1e-7 * (np.abs(m).max(initial=0) + np.abs(self.leaves).max(initial=0) + 1) * max(1, m.shape[1]) ** 0.5
        if k is not None:
            upper = _distances(m, self.leaves[self.rows > 0]) + self.radius[self.rows > 0] + slack  # each leaf holds all its rows within this
            order = np.argsort(upper, axis=1)
            enough = (np.cumsum(self.rows[self.rows > 0][order], axis=1) >= k).argmax(axis=1) if upper.size else None
            if upper.size and self.rows.sum() >= k:
                reach = np.minimum(reach, upper[np.arange(len(m)), order[np.arange(len(m)), enough]])
        top = _distances(m, self.tops) - self.top_radius <= (reach + slack)[:, None]
        for t in range(len(self.tops)):
            rows, own = np.flatnonzero(top[:, t]), np.arange(self.first[t], self.first[t + 1])
            own = own[self.rows[own] > 0]
            d = _distances(m[rows], self.leaves[own])
            i, j = np.nonzero((d - self.radius[own] <= (reach[rows] + slack)[:, None]) & (d >= (done[rows] - slack)[:, None]))
            at.append(rows[i])
            near.append(own[j])
            away.append(d[i, j])
        at, near, away = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, near, away))
        order = np.lexsort((near, away, at))
        cuts = np.searchsorted(at[order], np.arange(1, len(m)))
        return list(zip(np.split(near[order], cuts), np.split(away[order], cuts)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances up to rounding; bounds made of them keep a slack."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0))


def _means(points: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    words = points[np.random.default_rng(42).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = _distances(points, words).argmin(axis=1)
        counts, sums = np.bincount(near, minlength=k), np.zeros_like(words)
        np.add.at(sums, near, points)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def plant(base: DataFrame, nb: int) -> tuple[PivotTree, DataFrame]:
    """The tree over ``base`` and ``base`` with its leaf ``_c``, stored."""
    spark = base.sparkSession
    dims = base.select(F.size("v")).first()[0]
    count = PivotTree.wanted(nb, dims)
    size = min(nb, 8 * count + FAN_OUT, 4 * PIVOT_CELLS // max(1, dims))
    rows = base.select("v").orderBy(F.xxhash64("id"), "id").limit(size).collect()  # bounded by PIVOT_CELLS numbers
    tree = PivotTree.of(np.array([r["v"] for r in rows], dtype=np.float64), count)
    shared = spark.sparkContext.broadcast(tree)
    schema = T.StructType([*base.schema.fields]).add("_c", T.IntegerType()).add("_r", T.DoubleType()).add("_t", T.DoubleType())

    def assign(batches):
        for batch in batches:
            if len(batch):
                leaf, r, t = shared.value.place(_matrix(batch["v"]))
                yield batch.assign(_c=leaf.astype("int32"), _r=r, _t=t)

    placed = cut_lineage(base.mapInPandas(assign, schema))
    for r in placed.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.max("_r").alias("r"), F.max("_t").alias("t")).collect():  # a row per leaf
        tree.rows[r["_c"]], tree.radius[r["_c"]] = r["n"], r["r"]
        top = int(np.searchsorted(tree.first, r["_c"], side="right")) - 1
        tree.top_radius[top] = max(tree.top_radius[top], r["t"])
    return tree, placed.drop("_r", "_t")


def _sent(queries: DataFrame, tree: PivotTree, k: int | None = None, count: int | None = None) -> DataFrame:
    """``queries`` (.., _reach, _done) with the leaves ``_cs`` to visit now, at most ``count``; ``_done`` is infinite if none is left. Stored."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)
    schema = T.StructType([*queries.schema.fields]).add("_cs", T.ArrayType(T.IntegerType()))

    def send(batches):
        for batch in batches:
            for s in range(0, len(batch), 1_000):
                part = batch.iloc[s:s + 1_000]
                found = shared.value.visits(_matrix(part["v"]), *(part["_reach"].to_numpy(np.float64), k, part["_done"].to_numpy(np.float64)))
                last = [float(d[count - 1]) if count is not None and len(d) > count else np.inf for _, d in found]
                yield part.assign(_cs=[leaves[:count].astype("int32") for leaves, _ in found], _done=last)

    return cut_lineage(queries.mapInPandas(send, schema))


def _bundles(tree: PivotTree, block_rows: int) -> list[int]:
    """Per leaf, the bundle it belongs to: leaves in a row that hold at most ``block_rows`` rows, or one larger leaf."""
    out, bundle, held = [], 0, 0
    for n in tree.rows.tolist():
        if held and held + n > block_rows:
            bundle, held = bundle + 1, 0
        out.append(bundle)
        held += n
    return out


def _at_leaves(sent: DataFrame, placed: DataFrame, tree: PivotTree, work, schema: str, block_rows: int, merge=None) -> DataFrame:
    """``work`` of every leaf's visitors and rows, both in slices of bounded size.

    A query travels once per bundle of leaves, not once per leaf. ``merge`` reduces the answers of a bundle.
    """
    spark = sent.sparkSession
    bundles = _bundles(tree, min(block_rows, max(LEAF_ROWS, int(tree.rows.sum()) // (4 * spark.sparkContext.defaultParallelism))))
    names, own, answer = [c for c in sent.columns if c not in ("_cs", "_done")], [c for c in placed.columns if c != "_c"], [f.split()[0] for f in schema.split(", ")]

    def packed(names):
        def pack(batches):
            known = np.asarray(bundles)
            for batch in batches:
                rows, at, leaves = [], [], []
                for i, cs in enumerate(batch["_cs"]):
                    cs = np.asarray(cs, dtype=np.int64)
                    of = known[cs]
                    for g in np.unique(of).tolist():
                        rows.append(i)
                        at.append(g)
                        leaves.append(cs[of == g].astype("int32"))
                for s in range(0, len(rows), 10_000):
                    yield batch[names].iloc[rows[s:s + 10_000]].assign(_g=np.array(at[s:s + 10_000], "int32"), _cs=leaves[s:s + 10_000])

        kinds = T.StructType([sent.schema[c] for c in names]).add("_g", T.IntegerType()).add("_cs", T.ArrayType(T.IntegerType()))
        return sent.select(*names, "_cs").mapInPandas(pack, kinds)

    calls = {r["_g"]: r["n"] for r in packed([]).groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per bundle
    held = np.bincount(bundles, tree.rows, len(bundles))
    plan = [(g, _blocks(n, block_rows), _blocks(int(held[g]), block_rows)) for g, n in calls.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "_g int, _nq int, _nb int"))
    leaf = F.broadcast(spark.createDataFrame(list(enumerate(bundles)), "_c int, _g int"))  # a row per leaf
    q = packed(names).join(plan, "_g").withColumn("_q", _slice_of(F.col("_nq"))).withColumn("_b", F.explode(_upto(F.col("_nb")))).drop("_nq", "_nb")
    b = placed.select(*[F.col(c).alias(c) for c in placed.columns]).join(leaf, "_c").join(plan, "_g")
    b = b.withColumn("_b", _slice_of(F.col("_nb"))).withColumn("_q", F.explode(_upto(F.col("_nq")))).drop("_nq", "_nb")

    def visit(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) for x in q["_cs"]]
        called = np.concatenate([np.zeros(0, np.int64), *q["_cs"]])
        order = np.argsort(called, kind="stable")
        visitor, called = np.repeat(np.arange(len(q)), sizes)[order], called[order]
        q, none, stock = q[names], b[own].iloc[:0], dict(tuple(b[own].groupby(b["_c"])))
        found = [work(q.iloc[:0], none)]
        for c in np.unique(called).tolist():
            low, high = np.searchsorted(called, [c, c + 1])
            found.append(work(q.iloc[visitor[low:high]], stock.get(c, none)))
            if merge and sum(map(len, found[1:])) > 2 * len(found[0]) + 100_000:
                found = [merge(pd.concat(found))]
        return (merge(pd.concat(found)) if merge else pd.concat(found))[answer]

    return q.groupBy("_g", "_q", "_b").cogroup(b.groupBy("_g", "_q", "_b")).applyInPandas(visit, schema)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 0))


def distance_slices(q: np.ndarray, b: np.ndarray):
    """(start, exact Euclidean distances of a slice of queries to all base rows)."""
    step = max(1, SLICE_CELLS // max(1, b.size))
    for s in range(0, len(q), step):
        diff = q[s : s + step, None, :] - b[None, :, :]
        yield s, np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


def nearest(queries: DataFrame, base: DataFrame, k: int = 1, exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, rank 1..k, neighbour, distance); equal distances are ordered by neighbour id."""
    id_type = queries.schema["id"].dataType.simpleString()
    base_type = base.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, neighbour {base_type}, distance double"

    def work(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []}).astype({"distance": float})
        b = b.sort_values("id", kind="stable")
        ids, out = b["id"].to_numpy(), []
        qid, qm, bm = q["id"].to_numpy(), _matrix(q["v"]), _matrix(b["v"])
        reach = q["_reach"].to_numpy(np.float64) if "_reach" in q else None  # the k-th distance so far
        take = min(k + (1 if exclude_self else 0), len(ids))
        for s, d in distance_slices(qm, bm):
            best = np.argsort(d, axis=1, kind="stable")[:, :take]  # stable: base rows are in id order
            rows = np.repeat(np.arange(len(d)), take)
            flat, far = best.ravel(), d[rows, best.ravel()]
            if reach is not None:
                near = far <= reach[s + rows]
                rows, flat, far = rows[near], flat[near], far[near]
            out.append(pd.DataFrame({"id": qid[s + rows], "neighbour": ids[flat], "distance": far}))
        found = pd.concat(out)
        return found[found["id"] != found["neighbour"]] if exclude_self else found

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["distance", "neighbour"], kind="stable").groupby("id", sort=False, dropna=False).head(k)

    w = Window.partitionBy("id").orderBy("distance", "neighbour")  # k rows per block that met the query
    best = lambda hits: hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "distance")
    base = base.select(*[F.col(c).alias(c) for c in base.columns])
    nb = base.count()
    if nb <= block_rows:
        return best(blockwise(queries, base, work, schema, block_rows))
    tree, placed = plant(base, nb)
    count = k + (1 if exclude_self else 0)
    hits, sent = None, queries.withColumn("_reach", F.lit(float("inf"))).withColumn("_done", F.lit(0.0))
    for visits in (*ROUNDS, None):  # the k-th distance so far rules out leaves before the next ones are visited
        sent = _sent(sent, tree, count, visits)
        found = _at_leaves(sent, placed, tree, work, schema, block_rows, merge)
        hits = cut_lineage(best(found if hits is None else found.unionByName(hits.drop("rank")).dropDuplicates(["id", "neighbour"])))
        known = hits.where(F.col("rank") == k).select(F.col("id").alias("_id"), F.col("distance").alias("_far"))
        sent = sent.drop("_cs").where(F.col("_done") < float("inf")).join(known, F.col("id") == F.col("_id"), "left")
        sent = sent.withColumn("_reach", F.coalesce("_far", "_reach")).drop("_id", "_far")
    return hits


def assign_nearest(new: DataFrame, train: DataFrame) -> DataFrame:
    """(id, label): the payload of the closest training row."""
    hits = nearest(new, train, 1)
    return hits.join(train.select(F.col("id").alias("neighbour"), F.col("payload").alias("label")), "neighbour").select("id", "label", "distance")


def knn_vote(new: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """(id, prediction): majority of the k nearest; ties go to the smallest label."""
    hits = nearest(new, train, k).join(train.select(F.col("id").alias("neighbour"), "payload"), "neighbour")
    votes = hits.groupBy("id", "payload").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.min_by("payload", F.struct(-F.col("n"), F.col("payload"))).alias("prediction"))


def kth_distance(points: DataFrame, k: int) -> DataFrame:
    """(id, distance to the k-th nearest row, the row itself counting as the first)."""
    return nearest(points, points, k).groupBy("id").agg(F.max("distance").alias("distance"))


def neighbour_counts(points: DataFrame, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, number of rows within eps, itself included)."""
    id_type = points.schema["id"].dataType.simpleString()

    def work(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(q), dtype=np.int64)
        if len(q) and len(b):
            for s, d in distance_slices(_matrix(q["v"]), _matrix(b["v"])):
                n[s : s + len(d)] = (d <= eps).sum(axis=1)
        return pd.DataFrame({"id": q["id"], "n": n})

    return blockwise(points, points, work, f"id {id_type}, n bigint", block_rows, eps=eps).groupBy("id").agg(F.sum("n").alias("n"))


def least_label_within(queries: DataFrame, labelled: DataFrame, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, smallest label among the labelled rows within eps); rows without any are absent."""
    id_type = queries.schema["id"].dataType.simpleString()

    def work(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"id": q["id"].iloc[:0], "label": pd.Series([], dtype="int64")})
        b = b.sort_values("label", kind="stable")
        labels, out = b["label"].to_numpy(), []
        qid = q["id"].to_numpy()
        for s, d in distance_slices(_matrix(q["v"]), _matrix(b["v"])):
            near = d <= eps
            hit = near.any(axis=1)
            out.append(pd.DataFrame({"id": qid[s : s + len(d)][hit], "label": labels[near.argmax(axis=1)[hit]]}))
        return pd.concat(out)

    return blockwise(queries, labelled, work, f"id {id_type}, label bigint", block_rows, eps=eps).groupBy("id").agg(F.min("label").alias("label"))


def cluster_distance_sums(points: DataFrame) -> DataFrame:
    """(id, cluster, sum of distances to the rows of that cluster) for ``payload`` = cluster."""
    id_type = points.schema["id"].dataType.simpleString()

    def work(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(b["payload"], sort=True)
        out = []
        if len(q) and len(b):
            onehot = np.eye(len(names))[codes]
            qid = q["id"].to_numpy()
            for s, d in distance_slices(_matrix(q["v"]), _matrix(b["v"])):
                sums = d @ onehot
                out.append(pd.DataFrame({"id": np.repeat(qid[s : s + len(d)], len(names)), "cluster": np.tile(np.asarray(names), len(d)), "total": sums.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"id": q["id"].iloc[:0], "cluster": pd.Series([], dtype="int64"), "total": pd.Series([], dtype=float)})

    return blockwise(points, points.withColumn("payload", F.col("payload").cast("bigint")), work, f"id {id_type}, cluster bigint, total double").groupBy("id", "cluster").agg(F.sum("total").alias("total"))


def silhouette(points: DataFrame) -> DataFrame:
    """(id, s) with Euclidean distances: s = (b - a) / max(a, b), 0 for clusters of one row."""
    sizes = points.groupBy(F.col("payload").cast("bigint").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    own = points.select("id", F.col("payload").cast("bigint").alias("own"))
    means = cluster_distance_sums(points).join(sizes, "cluster").join(own, "id")
    inside = F.when(F.col("cluster") == F.col("own"), F.col("total") / F.when(F.col("n") > 1, F.col("n") - 1))
    other = F.when(F.col("cluster") != F.col("own"), F.col("total") / F.col("n"))
    ab = means.groupBy("id").agg(F.max(inside).alias("a"), F.min(other).alias("b"))
    a, b = F.col("a"), F.col("b")
    return ab.select("id", F.when(a.isNull() | b.isNull(), 0.0).when(F.greatest(a, b) == 0, 0.0).otherwise((b - a) / F.greatest(a, b)).alias("s"))


def silhouette_score(points: DataFrame) -> DataFrame:
    return silhouette(points).agg(F.avg("s").alias("silhouette"))
