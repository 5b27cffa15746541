"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering.

A 64-bit fingerprint is cut into a ring of ``segments``. If two fingerprints differ in at most
``distance`` bits, some segment starts a chain whose first 1, 2, 3, ... segments differ in at most
1, 2, 3, ... times ``distance / segments`` bits (rounded down). The first two links of the chain are
the join key (one side lists the values that the second budget allows), the longer chains prune
inside the join, and only then the whole Hamming distance is looked at.

Links are only needed up to connected components, so a first pass links neighbours in sorted order
inside a segment; the join skips pairs that are connected already. A family of very many near copies
therefore gives about one link per member and not one per pair.

Nulls and empties: a null or empty text has fingerprint zero and is linked like any other; a null id
takes part, and a component's name is its smallest id that is not null. Repeated rows stay.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.blocks import as_bytes, map_blocks, texts_of
from tabloom.operators.components import connected_components
from tabloom.session import cut_lineage

FLUSH = 400_000  # hashes whose bits are counted at once
PIECE = 60_000  # hashes of one text counted together; fits the 16-bit lanes below
LANES = np.uint64(0x0001_0001_0001_0001)


def _count_bits(counts: np.ndarray, pieces: list[tuple[int, list[int]]]) -> None:
    """Add to ``counts[row]`` how often each of the 64 bits is set in the hashes of a piece.

    Four bits that are 16 apart are counted at once in the four 16-bit lanes of one integer.
    """
    if not pieces:
        return
    hashes = np.fromiter(chain.from_iterable(p for _, p in pieces), dtype=np.uint64)
    starts = np.cumsum([0] + [len(p) for _, p in pieces[:-1]])
    rows = [row for row, _ in pieces]
    for bit in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, starts)
        for lane in range(4):
            np.add.at(counts[:, bit + 16 * lane], rows, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))


def fingerprint_texts(texts: list[bytes], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints; texts are processed whole, in pieces of bounded size."""
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    totals = np.zeros(len(texts), dtype=np.int64)
    pieces: list[tuple[int, list[int]]] = []
    waiting = 0
    for row, text in enumerate(texts):
        words = text.lower().split()  # bytes: only A-Z, and only space and \t-\r separate
        n = len(words)
        if n == 0:
            continue
        if n <= shingle:
            totals[row] = 1
            pieces.append((row, [digest(b" ".join(words), seed)]))
            waiting += 1
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            a, b = starts[: n - shingle + 1].tolist(), ends[shingle - 1:].tolist()
            totals[row] = len(a)
            for at in range(0, len(a), PIECE):
                piece = [digest(joined[x:y], seed) for x, y in zip(a[at:at + PIECE], b[at:at + PIECE])]
                pieces.append((row, piece))
                waiting += len(piece)
                if waiting >= FLUSH:
                    _count_bits(counts, pieces)
                    pieces, waiting = [], 0
    _count_bits(counts, pieces)
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed bigint."""

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            fp = fingerprint_texts(as_bytes(block.column("text")), shingle, seed).astype(np.int64)
            return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

        return work

    return map_blocks(texts_of(docs, "doc_id"), make, "doc_id bigint, fp bigint")


class Ring:
    """Segments of the fingerprint, from the highest bit down, with the budgets of a chain."""

    def __init__(self, distance: int = 4, segments: int = 5):
        if not distance < segments <= 16:
            raise ValueError("the ring needs more segments than differing bits, and at most 16")
        self.distance, self.segments = distance, segments
        self.widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
        self.offsets = [64 - sum(self.widths[: i + 1]) for i in range(segments)]
        self.budgets = [(k + 1) * distance // segments for k in range(segments)]

    def value(self, fp: Column, i: int) -> Column:
        i %= self.segments
        return F.shiftrightunsigned(fp, self.offsets[i]).bitwiseAND(F.lit((1 << self.widths[i]) - 1))

    def mask(self, start: int, length: int) -> int:
        bits = 0
        for k in range(length):
            i = (start + k) % self.segments
            bits |= ((1 << self.widths[i]) - 1) << self.offsets[i]
        return bits - (1 << 64) if bits >> 63 else bits

    def key(self, fp: Column, i: int, flip: int = 0) -> Column:
        second = self.value(fp, i + 1)
        second = second.bitwiseXOR(F.lit(flip)) if flip else second
        high = F.lit(i << 58).bitwiseOR(F.shiftleft(self.value(fp, i), self.widths[(i + 1) % self.segments]))
        return high.bitwiseOR(second)

    def flips(self, i: int) -> list[int]:
        """What the second segment of a chain may differ by: nothing, or one bit where the budget allows it."""
        return [0] + [1 << b for b in range(self.widths[(i + 1) % self.segments])] * (self.budgets[1] > 0)

    def chain_holds(self, a: Column, b: Column, start: Column) -> Column:
        """Cumulative differences of the chains from ``start`` within their budgets, then the whole distance."""
        differing = a.bitwiseXOR(b)
        holds = F.lit(True)
        for length in range(3, self.segments):
            masks = F.array(*[F.lit(self.mask(i, length)) for i in range(self.segments)])
            holds = holds & (F.bit_count(differing.bitwiseAND(F.get(masks, start))) <= self.budgets[length - 1])
        return holds & (F.bit_count(differing) <= self.distance)


def sorted_links(nodes: DataFrame, ring: Ring, reach: int = 2) -> DataFrame:
    """Links (u, v) between fingerprints that share a segment and stand next to each other in rotated order."""
    fp = F.col("fp")
    rows = []
    for i in range(ring.segments):
        top = 64 - ring.offsets[i] - ring.widths[i]  # bits above the segment
        rotated = F.shiftleft(fp, top).bitwiseOR(F.shiftrightunsigned(fp, 64 - top)) if top else fp
        rows.append(F.struct(F.lit(i).alias("i"), ring.value(fp, i).alias("s"), rotated.alias("r")))
    spread = nodes.select("fp", F.inline(F.array(*rows)))
    order = Window.partitionBy("i", "s").orderBy("r", "fp")
    ahead = spread.select("fp", F.array(*[F.lead("fp", k).over(order) for k in range(1, reach + 1)]).alias("next"))
    pairs = ahead.select(F.col("fp").alias("u"), F.explode("next").alias("v"))
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= ring.distance).distinct()


def ring_pairs(known: DataFrame, ring: Ring) -> DataFrame:
    """(fp_u, comp_u, fp_v, comp_v): close fingerprints of different components, each pair once or more; ``known`` has fp and comp."""
    fp = F.col("fp")
    index = known.select(F.col("fp").alias("fp_u"), F.col("comp").alias("comp_u"), F.explode(F.array(*[ring.key(fp, i) for i in range(ring.segments)])).alias("key"))
    probes = [ring.key(fp, i, flip) for i in range(ring.segments) for flip in ring.flips(i)]
    probe = known.select(F.col("fp").alias("fp_v"), F.col("comp").alias("comp_v"), F.explode(F.array(*probes)).alias("key"))
    start = F.shiftrightunsigned(F.col("key"), 58).cast("int")
    found = index.join(probe, "key").where((F.col("comp_u") < F.col("comp_v")) & ring.chain_holds(F.col("fp_u"), F.col("fp_v"), start))
    return found.select("fp_u", "comp_u", "fp_v", "comp_v")


def link_components(nodes: DataFrame, distance: int = 4, segments: int = 5) -> DataFrame:
    """(fp, component) for distinct fingerprints: components of the links at up to ``distance`` bits."""
    ring = Ring(distance, segments)
    near = connected_components(sorted_links(nodes, ring))
    known = nodes.join(near, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("comp"))
    known = cut_lineage(known)
    found = ring_pairs(known, ring).select(F.col("comp_u").alias("comp_a"), F.col("comp_v").alias("comp_b"))
    merged = connected_components(found.select(F.col("comp_a").alias("u"), F.col("comp_b").alias("v")))
    return known.join(merged, F.col("comp") == F.col("node"), "left").select("fp", F.coalesce("component", "comp").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = 4, segments: int = 5, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: hex fingerprint, smallest doc_id reachable over links."""
    fps = cut_lineage(fingerprints(docs, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comps = cut_lineage(link_components(nodes.select("fp"), distance, segments).join(nodes, "fp"))
    names = comps.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = comps.join(names, "component").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
