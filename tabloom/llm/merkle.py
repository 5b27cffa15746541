"""A hash-tree manifest of a dataset with an inclusion proof for every row, by pointer jumping.

Rows are leaves, in the order of ``order`` within their group. Every ``FAN_OUT`` consecutive nodes of a level
make their parent, until one node of the group is left: its subroot. Subroots in the order of their groups are
the lowest level of one more tree of the same kind, which ends in the root.

Proofs: each node holds its siblings (those to the left and those to the right of it) and a pointer to its
parent. One self-join appends the siblings held by the node pointed at and takes over its pointer, so the
distance to the ancestor doubles per round until all pointers have passed the root. Only inner nodes jump; the
rows of one run share all that lies above them and take it in one last join, at a sixteenth of the rows.
A node at distance d is pointed at by up to ``FAN_OUT**d`` nodes, but there are few such targets: they are
broadcast once they are counted to be few, and before that no target has many pointers. Nodes whose pointer has
passed the root stay where the round before stored them.

Every partition of a stored table is a file of its own, for which some file systems start a process. A level
is a sixteenth of the one below it, so its partitions follow its nodes (at most about ``NODES`` taken in by a
task) and not the shuffle partitions, which follow the rows.

Nulls and ties: a null value is a leaf field like others; null groups and null order keys come first; rows
with equal order keys are ordered by their digest (rows equal in both are alike). An empty table has no leaves
and no root. Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ranking import global_row_number
from tabloom.session import broadcast_if_small, cut_lineage

FAN_OUT = 16
TOP = -1  # the number of the tree above the subroots
NODES = 4_096  # nodes that a task takes in to build the level above them
TARGETS = 8_192  # nodes pointed at that may be broadcast, divided by the siblings' levels that each holds
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _step(run: Column, at: Column) -> Column:
    """Siblings of the member at ``at`` of ``run``, left and right of it."""
    return F.struct(F.array_join(F.slice(run, F.lit(1), at), "").alias("left"),
                    F.array_join(F.slice(run, at + 2, F.greatest(F.size(run) - at - 1, F.lit(0))), "").alias("right"))


def _slot(at: Column, fan_out: int) -> Column:
    return F.pmod(at, F.lit(fan_out)).cast("int")


def _above(at: Column, fan_out: int) -> Column:
    return F.floor(at / fan_out).cast("bigint")


def _tasks(nodes: int) -> int:
    return max(1, -(-nodes // NODES))


def _grow(nodes: DataFrame, level: int, most: int, count: int, trees: int, fan_out: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Build the levels above ``nodes`` (tree, at, m, hash, key), where m is the node count of the tree's level.

    ``most`` is the largest m, ``count`` the number of nodes or a bound of it.
    Returns the pointers (key, up, path) of all nodes below a top, and the tops (tree, hash, key).
    """
    pointers, tops = [], []
    while True:
        tops.append(nodes.where("m = 1").select("tree", "hash", "key"))
        if most <= 1:
            return pointers, tops
        level, most = level + 1, -(-most // fan_out)
        run = F.sort_array(F.collect_list(F.struct("at", "hash", "key"))).alias("run")
        grouped = nodes.where("m > 1").groupBy("tree", _above(F.col("at"), fan_out).alias("up_at")).agg(run, F.first("m").alias("m"))
        me = F.struct(F.col("tree"), F.lit(level).alias("level"), F.col("up_at").alias("at"))
        grouped = grouped.select("tree", "run", F.col("up_at").alias("at"), F.ceil(F.col("m") / fan_out).alias("m"), me.alias("key"))
        grouped = cut_lineage(grouped.coalesce(_tasks(count)))
        count = count // fan_out + trees
        below = grouped.select(F.col("key").alias("up"), F.col("run.hash").alias("hashes"), F.explode("run").alias("x"))
        pointers.append(below.select("x.key", "up", F.array(_step(F.col("hashes"), _slot(F.col("x.at"), fan_out))).alias("path")))
        nodes = grouped.select("tree", "at", "m", F.sha2(F.array_join("run.hash", ""), 256).alias("hash"), "key")


def _jump(pointers: DataFrame, height: int) -> DataFrame:
    """(key, path): all steps from a node to the root."""
    going, done = cut_lineage(pointers), []
    for k in range(max(0, math.ceil(math.log2(max(1, height))))):
        nodes = reduce(DataFrame.unionByName, [*done, going])
        ahead = nodes.where((F.col("key.tree") == TOP) | (F.col("key.level") > 2**k))  # only these are 2**k above another node
        ahead = broadcast_if_small(ahead.select(F.col("key").alias("target"), F.col("up").alias("next"), F.col("path").alias("rest")), TARGETS >> k)
        if k:
            done.append(going.where("up IS NULL"))
        longer = going.where("up IS NOT NULL").join(ahead, F.col("up") == F.col("target"), "left")
        rest = F.coalesce("rest", F.array().cast(f"array<{STEP}>"))
        going = cut_lineage(longer.select("key", F.col("next").alias("up"), F.concat("path", rest).alias("path")))
    return reduce(DataFrame.unionByName, [*done, going]).select("key", "path")


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", fan_out: int = FAN_OUT) -> DataFrame:
    """``leaves`` (group, order, leaf and other small columns) with ``subroot``, ``root`` and ``path``.

    ``leaf`` is the hex digest of the row. ``path`` lists, from the row up to the root, the digests of the
    siblings to the left and to the right, joined.
    """
    sort = [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first(), F.col("leaf")]
    rows = global_row_number(leaves, sort, "_place", single_task_rows=0)  # stored there, before the places are added
    groups = rows.groupBy(group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = cut_lineage(global_row_number(groups, [F.col(group).asc_nulls_first()], "_tree"))
    trees, most, count = groups.agg(F.count(F.lit(1)), F.max("_n"), F.sum(F.ceil(F.col("_n") / fan_out))).first()
    if not trees:
        return leaves.select("*", *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root")], F.lit(None).cast(f"array<{STEP}>").alias("path"))

    named = groups.withColumnRenamed(group, "_group")
    rows = rows.join(broadcast_if_small(named), F.col(group).eqNullSafe(F.col("_group"))).withColumn("_at", F.col("_place") - F.col("_first"))
    level = F.when(F.col("_n") > 1, 1).otherwise(0)  # a lone leaf is a node of the upper tree itself
    members = F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), F.struct(*leaves.columns).alias("row")))).alias("run")
    runs = rows.groupBy("_tree", level.alias("_level"), _above(F.col("_at"), fan_out).alias("_up")).agg(members, F.first("_n").alias("n"))
    hashes = F.col("run.row.leaf")
    runs = cut_lineage(runs.select(F.struct(F.col("_tree").alias("tree"), F.col("_level").alias("level"), F.col("_up").alias("at")).alias("key"), "run", "n",
                                   F.when(F.col("_level") == 1, F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0]).alias("hash")))

    lowest = runs.select("key.tree", "key.at", F.ceil(F.col("n") / fan_out).alias("m"), "hash", "key")
    lowest = cut_lineage(lowest.repartition(_tasks(count)))  # without the rows
    pointers, tops = _grow(lowest, 1, -(-most // fan_out), count, trees, fan_out)
    subroots = cut_lineage(reduce(DataFrame.unionByName, tops))
    upper = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("bigint").alias("m"), "hash", "key")
    upper_pointers, roots = _grow(upper, 0, trees, trees, 1, fan_out)
    root = roots[-1].first()["hash"]

    steps = pointers + upper_pointers
    paths = reduce(DataFrame.unionByName, steps) if steps else lowest.limit(0).select("key", F.col("key").alias("up"), F.array().cast(f"array<{STEP}>").alias("path"))
    paths = _jump(paths, len(steps))

    held = runs.select("key", "run").join(paths, "key", "left").join(broadcast_if_small(subroots.select("tree", F.col("hash").alias("subroot"))), F.col("key.tree") == F.col("tree"))
    out = held.select("key", "subroot", "path", F.col("run.row.leaf").alias("hashes"), F.posexplode("run").alias("i", "x"))
    own = F.when(F.col("key.level") == 1, F.array(_step(F.col("hashes"), F.col("i")))).otherwise(F.array().cast(f"array<{STEP}>"))
    path = F.concat(own, F.coalesce("path", F.array().cast(f"array<{STEP}>")))
    return out.select("x.row.*", "subroot", F.lit(root).alias("root"), path.alias("path"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def lower_ascii(text: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def prove_documents(docs: DataFrame, tampers: int = 5) -> DataFrame:
    """Manifest of ``docs`` by source and the check of every proof, against a tampered text where ``tampers`` divides the crc32 of the id."""
    fields = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(tampers)) == 0, digest(*fields, field(lower_ascii(F.col("text")))))
    leaves = docs.select("doc_id", "source", digest(*fields, field(F.col("text"))).alias("leaf"), tampered.alias("tampered"))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = manifest(leaves).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
