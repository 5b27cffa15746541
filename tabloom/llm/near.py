"""Near copies by the Jaccard similarity of word shingles, for the pipeline: SimHash first, rare shingles for the rest.

A text is the set of its shingles, hashed to 64 bits; texts with equal sets are one node. A candidate pair becomes
a link only if the similarity of the whole sets reaches the threshold, so nothing goes that is not a near
copy. Links are only needed up to connected components, so every pass looks at pairs of different components only.

1. SimHash and its pigeonring index (``simhash``) give the pairs whose fingerprints differ in at most ``DISTANCE``
   bits: first the nearest neighbour in sorted order, then what the chains of the ring find between components.
2. A similarity of 0.8 is about ten bits, which the index does not reach. Sets that share one of ``BANDS`` MinHash keys of
   ``PER_BAND`` minima (chance 1 - (1 - s**PER_BAND)**BANDS: 0.99994 at 0.8, more above) with another component
   are joined by prefix filtering, which is exact: with shingles ordered by frequency, two similar sets share one of their
   n - ceil(0.8 n) + 1 rarest, and what lies behind the first shared one still has to hold the overlap. Copies
   that differ too much differ in their rarest shingles and make no pair, however many share a key. Shingles of few
   sets come first; the sets of frequent ones meet in small random buckets before the pairs still open are formed.

Nulls and empties: a null text is an empty one, and all empty ones are equal. Rows with a null id take part
like others; an id that is not null is smaller. Ids may repeat. Rows and sets are named by 128 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import simhash
from tabloom.llm.blocks import as_bytes, fresh, map_blocks
from tabloom.operators.components import connected_components
from tabloom.session import broadcast_if_small, cut_lineage

BANDS, PER_BAND = 32, 6
DISTANCE, SEGMENTS = 4, 5
FEW = 16  # sets with a shingle up to which its pairs are formed at once
BUCKET = 8
SMALL = 200_000  # links up to which their components are found in one task
MIX = np.uint64(0x9E37_79B9_7F4A_7C15)


def shingles_of(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words as in ``simhash``. A shorter text is one shingle, an empty one none."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), min(shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1:].tolist())), np.uint64, n - size + 1))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Keys (set, band) of sets that are not empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.concatenate(sets).astype(np.uint32)
    r = np.random.default_rng(42)
    factors = r.integers(0, 1 << 31, BANDS * PER_BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = r.integers(0, 1 << 32, BANDS * PER_BAND, dtype=np.uint32)
    keys, hashed = np.empty((len(sets), BANDS), np.uint64), np.empty_like(values)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64) * MIX
        for i in range(band * PER_BAND, (band + 1) * PER_BAND):
            np.multiply(values, factors[i], out=hashed)
            np.add(hashed, offsets[i], out=hashed)
            key = (key ^ np.minimum.reduceat(hashed, starts)) * MIX
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


def simhash_of(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of sets that are not empty: a bit is set if it is in over half of the hashes."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([np.arange(e - n, e, simhash.PIECE) for e, n in zip(ends, sizes)]))  # pieces fit the 16-bit lanes
    owner = np.searchsorted(ends, cuts, side="right")
    flat, counts = np.concatenate(sets), np.zeros((len(sets), 64), np.int64)
    for bit in range(16):
        sums = np.add.reduceat((flat >> np.uint64(bit)) & simhash.LANES, cuts)
        for lane in range(4):
            np.add.at(counts[:, bit + 16 * lane], owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """(digest, doc_id, s1, s2, n, fp, keys) of rows (digest, doc_id, text): s1, s2 name the set of n shingles."""

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles_of(t, shingle) for t in as_bytes(block.column("text"))]
            sizes, some = np.array([len(s) for s in sets], np.int64), [s for s in sets if len(s)]
            names = [np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).astype(np.int64) for seed in (0, 1)]
            fp = np.zeros(len(sets), np.uint64)
            fp[sizes > 0] = simhash_of(some) if some else []
            keys = band_keys(some) if some else np.zeros((0, BANDS), np.uint64)
            ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.astype(np.int64).ravel()))
            return pa.RecordBatch.from_arrays([block.column("digest"), block.column("doc_id"), *map(pa.array, names), pa.array(sizes), pa.array(fp.astype(np.int64)), lists],
                                              ["digest", "doc_id", "s1", "s2", "n", "fp", "keys"])

        return work

    digest = rows.schema["digest"].dataType.simpleString()
    return map_blocks(rows, make, f"digest {digest}, doc_id bigint, s1 bigint, s2 bigint, n bigint, fp bigint, keys array<bigint>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of rows (node, text), one row per node."""

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles_of(t, shingle).astype(np.int64) for t in as_bytes(block.column("text"))]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            return pa.RecordBatch.from_arrays([block.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "shingles"])

        return work

    return map_blocks(rows, make, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _needed(a: Column, b: Column, similarity: float) -> Column:
    """Least overlap of sets of these sizes."""
    return F.ceil((a + b) * (similarity / (1 + similarity)) - 1e-9)


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough; each pair carries one set to the other."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs, sets = broadcast_if_small(cut_lineage(pairs)), sets.select("node", "shingles")
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    common = both.select("u", "v", (F.size("a") + F.size("b")).alias("total"), F.size(F.array_intersect("a", "b")).alias("common"))
    return cut_lineage(common.where(F.col("common") / (F.col("total") - F.col("common")) >= similarity).select("u", "v"))


def _join(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node, comp, ...) with the components that ``links`` between nodes unite."""
    if links.isEmpty():  # stored before, so this reads one row
        return nodes
    links, comp = broadcast_if_small(links), nodes.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    ends = broadcast_if_small(cut_lineage(comp.join(links, F.col("u") == F.col("_n")).select("v", F.col("_c").alias("a"))))
    ends = comp.join(ends, F.col("v") == F.col("_n")).select(F.col("a").alias("u"), F.col("_c").alias("v"))
    found = broadcast_if_small(cut_lineage(connected_components(ends, single_task_rows=SMALL).withColumnRenamed("node", "_node")))
    joined = nodes.join(found, F.col("comp") == F.col("_node"), "left").withColumn("comp", F.coalesce("component", "comp"))
    return cut_lineage(joined.select(*nodes.columns))


def _shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) of the MinHash keys that several nodes have."""
    members = nodes.select("node", F.explode("keys").alias("key"))
    return members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "key", "left_semi")


def _open(members: DataFrame, group: str) -> DataFrame:
    """``members`` of the groups in which components differ; they have ``comp``."""
    mixed = members.groupBy(group).agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select(group)
    return members.join(mixed, group, "left_semi")


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(token, df, node, n, pos, near): the rarest shingles of each set that others have too.

    ``pos`` counts from the rarest; ``near`` marks the shorter prefix that suffices for the smaller set of a pair.
    """
    tokens = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = tokens.join(frequency, "token")
    # All tokens of one set come before those shared by others, so positions start behind the unshared ones.
    shared = known.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))
    n, alone = F.col("n"), F.col("n") - F.size("all")
    length = n - F.ceil(n * similarity - 1e-9) + 1
    short = n - F.ceil(n * (2 * similarity / (1 + similarity)) - 1e-9) + 1
    cut = shared.select("node", "n", alone.alias("alone"), short.alias("short"), F.slice("all", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int")).alias("all"))
    out = cut.select("node", "n", "alone", "short", F.posexplode("all").alias("i", "x"))
    pos = F.col("alone") + F.col("i")
    return out.select("x.token", "x.df", "node", "n", pos.alias("pos"), (pos < F.col("short")).alias("near"))


def _may_link(a: str, b: str, similarity: float) -> Column:
    """Sizes allow it, components differ, and so much is left behind the shared token."""
    n = lambda x: F.col(f"{x}.n")
    left = F.least(n(a) - F.col(f"{a}.pos"), n(b) - F.col(f"{b}.pos"))
    return (F.least(n(a), n(b)) >= similarity * F.greatest(n(a), n(b)) - 1e-9) & (left >= _needed(n(a), n(b), similarity)) & (F.col(f"{a}.comp") != F.col(f"{b}.comp"))


def _token_pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) that share a token of the short prefix of the smaller set and of the prefix of the other."""
    one = F.struct("node", "n", "pos", "comp")
    big, small = entries.select("token", one.alias("a")), entries.where("near").select("token", one.alias("b"))
    smaller = (F.col("b.n") < F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.node") < F.col("a.node")))
    return big.join(small, "token").where(smaller & _may_link("a", "b", similarity)).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def _bucket_pairs(entries: DataFrame, similarity: float, deals: int = 2) -> DataFrame:
    """Pairs within random buckets of about ``BUCKET`` members of a token, dealt anew ``deals`` times: linear in the members, yet a dense family comes together."""
    sizes = entries.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("parts"))
    dealt = entries.join(sizes, "token").withColumn("deal", F.explode(F.array(*map(F.lit, range(deals)))))
    dealt = dealt.withColumn("token", F.xxhash64("token", "deal", F.pmod(F.xxhash64("deal", "node"), F.col("parts"))))
    return _token_pairs(dealt.drop("parts", "deal"), similarity)


def _simhash_pairs(comps: DataFrame, ring: simhash.Ring, first: bool) -> DataFrame:
    """Pairs (u, v) of nodes with close fingerprints; one node stands for its fingerprint in each component."""
    if first:
        same = comps.groupBy("fp").agg(F.min("node").alias("hub"))
        alike = comps.join(same, "fp").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
        near = simhash.sorted_links(same.select("fp"), ring).select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
        near = near.groupBy("x").agg(F.min(F.struct(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))), "y"))["y"].alias("y"))  # the nearest
        ends = near.join(same.select(F.col("fp").alias("x"), F.col("hub").alias("u")), "x").join(same.select(F.col("fp").alias("y"), F.col("hub").alias("v")), "y")
        return alike.unionByName(ends.select("u", "v"))
    nodes = cut_lineage(comps.groupBy("fp", "comp").agg(F.min("node").alias("node")))
    found = simhash.ring_pairs(nodes.select("fp", "comp"), ring)
    named = lambda x: nodes.select(F.col("fp").alias(f"fp_{x}"), F.col("comp").alias(f"comp_{x}"), F.col("node").alias(x))
    return found.join(named("u"), ["fp_u", "comp_u"]).join(named("v"), ["fp_v", "comp_v"]).select("u", "v")


def components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, s1, s2, comp, first) of ``docs`` (digest, doc_id, text), and their signatures (digest, doc_id, s1, s2)."""
    signed = _signatures(docs, shingle)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")
    nodes = signed.groupBy("s1", "s2").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))  # stored, so they stay
    members = cut_lineage(_shared_keys(nodes))
    comps = nodes.select("node", "fp", F.col("node").alias("comp"))

    ring = simhash.Ring(DISTANCE, SEGMENTS)
    pairs = cut_lineage(_simhash_pairs(comps, ring, True))
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(members.select("node")).distinct()
    wanted = cut_lineage(wanted.join(nodes, "node").select("node", F.col("first.digest").alias("digest")))
    sets = cut_lineage(_sets(docs.select("digest", "text").join(broadcast_if_small(wanted), "digest").select("node", "text"), shingle))
    comps = _join(comps, _links(pairs, sets, similarity))
    pairs = cut_lineage(_simhash_pairs(comps, ring, False))
    others = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(sets, "node", "left_anti")
    others = others.join(nodes, "node").select("node", F.col("first.digest").alias("digest"))
    more = _sets(docs.select("digest", "text").join(broadcast_if_small(cut_lineage(others)), "digest").select("node", "text"), shingle)
    comps = _join(comps, _links(pairs, sets.unionByName(more), similarity))

    apart = _open(members.join(comps.select("node", "comp"), "node"), "key").select("node").distinct()
    entries = cut_lineage(prefixes(sets.join(apart, "node", "left_semi"), similarity))
    few, many = F.col("df") <= FEW, F.col("df") > FEW
    for some, form in ((few, _token_pairs), (many, _bucket_pairs), (many, _token_pairs)):
        still = cut_lineage(_open(entries.where(some).join(comps.select("node", "comp"), "node"), "token"))
        comps = _join(comps, _links(form(still, similarity), sets, similarity))
    return nodes.select("node", "s1", "s2", "first").join(comps.select("node", "comp"), "node"), signed


def row_digest(docs: DataFrame) -> Column:
    """128 bits of the whole row; a null alone would not change the digest, and maps have none."""
    parts = [x for f in docs.schema.fields for c in [F.col(f"`{f.name}`")] for x in (c.isNull(), F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c)]
    return F.struct(F.xxhash64(*parts).alias("d1"), F.xxhash64(F.lit(1), *parts).alias("d2"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each component of near copies: the one with the smallest id, then by a digest of the row."""
    name = fresh(docs, "_digest")
    marked = docs.withColumn(name, row_digest(docs))
    nodes, _ = components(marked.select(F.col(name).alias("digest"), "doc_id", "text"), similarity, shingle)
    chosen = cut_lineage(nodes.groupBy("comp").agg(F.min("first").alias("first")).select(F.col("first.digest").alias(name)))
    return marked.join(chosen, name, "left_semi").dropDuplicates([name]).drop(name)  # texts move once
