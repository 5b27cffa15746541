"""I-Match document fingerprints, in DataFrame expressions only.

Terms are lower-cased words. The lexicon holds the terms whose share of documents lies in a band, so
neither words that everybody uses nor words that hardly anybody uses count. As a term of the lexicon
is in at least ``low`` of all documents, the lexicon has at most (mean distinct terms of a document)
/ ``low`` terms however many documents there are; it is passed to the expressions as one constant,
arranged in short lists by the last bits of a term's hash.

A fingerprint is made of 64 hashes, one for each of 64 random subsets of the lexicon: the document's
distinct terms in the subset, sorted, are hashed together. Subsets come in four densities, because a
subset is informative when it meets a handful of a document's terms. Two fingerprints are as alike
as the share of equal hashes among the subsets that either text meets, in the density where that
says most.

Nulls and empties: a null text is an empty one; texts without terms have the fingerprint of no terms,
and its likeness to itself is 1. ``edited_fingerprints`` hashes all terms of a text that meets no
subset, so different ones stay different; ``fingerprint`` gives these the fingerprint of no terms.
Equal texts have equal fingerprints.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = (0.002, 0.05)  # shares of documents between which a term's document frequency lies
LISTS = 1 << 14  # short lists that the lexicon is arranged in
PER_DENSITY = 16  # subsets of each density
DENSITIES = (4, 6, 8, 10)  # a subset holds one in 2**d terms
NONE = 42  # hash of no terms
ROWS_PER_STRETCH = 2_000  # documents that are put in order in one go
MOST_STRETCHES = 1 << 16  # beyond, stretches grow
LEAST_ID = -(1 << 63)
FEW = 4  # subsets that must be met in a density before its share counts


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> Column:
    """The lexicon as one constant: LISTS short arrays of term hashes.

    A term counts once per document. The counts are combined in each task before they are moved. Only
    the lexicon reaches the driver; the module's text says why it is bounded.
    """
    low, high = band
    n = docs.agg(F.count(F.lit(1))).first()[0]
    frequency = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # A tiny corpus has a band of one document at least.
    inside = frequency.where((F.col("df") >= low * n) & (F.col("df") <= max(high * n, 1.0)))
    found: list[list[int]] = [[] for _ in range(LISTS)]
    for row in inside.select("term").toLocalIterator():
        found[row[0] % LISTS].append(row[0])
    return F.from_json(F.lit(json.dumps(found)), "array<array<bigint>>")


def memberships(term: Column) -> Column:
    """Bit k is set if the term is in subset k: a number of random words, and-ed, gives the density."""
    words = [F.xxhash64(term, F.lit(i)) for i in range(max(DENSITIES))]
    out = None
    for i, word in enumerate(words):
        # Densities that need no more words keep their bits.
        done = sum(((1 << PER_DENSITY) - 1) << (PER_DENSITY * k) for k, d in enumerate(DENSITIES) if d <= i)
        done = done - (1 << 64) if done >> 63 else done
        word = word.bitwiseOR(F.lit(done)) if done else word
        out = word if out is None else out.bitwiseAND(word)
    return out


def _in_any(bits: int) -> Callable[[Column], Column]:
    bits = bits - (1 << 64) if bits >> 63 else bits
    return lambda member: member["m"].bitwiseAND(F.lit(bits)) != 0


def with_hashes(docs: DataFrame, text: str, lists: Column, name: str, fallback: bool = False) -> DataFrame:
    """``docs`` with ``name``: 64 hashes of the text's sorted lexicon terms, one per subset; NONE where it has no term of the subset.

    Terms, and those of each density, are columns of their own first: the terms are worked out once,
    and a thin subset is looked for only among the few terms that are in any of its density. With
    ``fallback``, a text that has terms but none in any subset gets 64 hashes of all its terms.
    """
    known = F.filter(terms(F.col(text)), lambda t: F.array_contains(F.get(lists, F.pmod(t, F.lit(LISTS)).cast("int")), t))
    out = docs.withColumn("_members", F.transform(F.array_sort(known), lambda t: F.struct(t.alias("t"), memberships(t).alias("m"))))
    groups = {f"_density{d}": ((1 << PER_DENSITY) - 1) << (PER_DENSITY * k) for k, d in enumerate(DENSITIES)}
    out = out.withColumns({group: F.filter("_members", _in_any(bits)) for group, bits in groups.items()})
    each = [F.hash(F.filter(group, _in_any(1 << (PER_DENSITY * k + i)))) for k, group in enumerate(groups) for i in range(PER_DENSITY)]
    out = out.withColumn(name, F.array(*each)).drop("_members", *groups)
    if not fallback:
        return out
    all_terms = F.xxhash64(F.array_sort(terms(F.col(text))))  # worked out for these few texts only
    whole = F.transform(F.sequence(F.lit(0), F.lit(len(each) - 1)), lambda k: F.hash(all_terms, k))
    unmet = (F.array_min(name) == NONE) & (F.array_max(name) == NONE) & (F.trim(F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")) != "")
    return out.withColumn(name, F.when(unmet, whole).otherwise(F.col(name)))


def as_string(values: Column) -> Column:
    """Eight hex digits per subset."""
    return F.array_join(F.transform(values, lambda h: F.right(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit(8))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: share of equal hashes among the subsets that either text meets, in the best density.

    A density counts if it has FEW such subsets; if none has, all densities count together. Two texts
    that meet no subset at all are alike.
    """
    def share(start: int, length: int, least: int) -> Column:
        pairs = F.filter(F.arrays_zip(F.slice(a, start + 1, length).alias("a"), F.slice(b, start + 1, length).alias("b")), lambda p: (p["a"] != NONE) | (p["b"] != NONE))
        same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
        return F.when(F.size(pairs) >= least, same / F.size(pairs))

    each = [share(PER_DENSITY * k, PER_DENSITY, FEW) for k in range(len(DENSITIES))]
    best = F.greatest(*each)
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(best, share(0, PER_DENSITY * len(DENSITIES), 1), F.lit(1.0)))


def fingerprint(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``docs`` with the column ``fingerprint``."""
    return with_hashes(docs, "text", lexicon(docs, band), "fingerprint").withColumn("fingerprint", as_string(F.col("fingerprint")))


def _cuts(docs: DataFrame, pieces: int) -> tuple[list[int], dict[int, int]]:
    """At most 2 * ``pieces`` ids that cut the documents into stretches of about equal size, and the pieces of crowded stretches.

    An id with several of these sizes of its own, and the ids that are null, are crowded: such an id gets a stretch for itself,
    which is cut further by digest.
    """
    shares = [i / pieces for i in range(1, pieces)]
    nulls = F.count_if(F.col("doc_id").isNull())
    row = docs.agg(F.percentile_approx("doc_id", shares, 10_000) if shares else F.lit(None), nulls, F.count(F.lit(1))).first()
    found = row[0] or []
    repeats = {c: n for c, n in Counter(found).items() if n > 1}
    # The stretch of a cut holds the ids above the cut before it.
    cuts = sorted({*found, *[c - 1 for c in repeats if c > LEAST_ID]})
    crowded = {len(cuts) - cuts.index(c): n + 1 for c, n in repeats.items()}
    crowded[len(cuts) + 1] = math.ceil(row[1] * pieces / max(row[2], 1))
    return cuts, {k: n for k, n in crowded.items() if n > 1}


def stretch_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of the stretch of an id: 0 holds the largest ids; ids that are null come last. Looked up in two steps."""
    if not cuts:
        return F.when(doc_id.isNull(), F.lit(1)).otherwise(F.lit(0))
    step = max(1, math.isqrt(len(cuts)))
    rows = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    below = lambda edges: F.size(F.filter(edges, lambda c: c < doc_id))
    heads = F.from_json(F.lit(json.dumps([r[0] for r in rows])), "array<bigint>")
    row = F.greatest(below(heads) - 1, F.lit(0))
    inner = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
    return F.when(doc_id.isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - (row * step + below(F.get(inner, row))))


def with_next(rows: DataFrame, carried: list[str], pieces: int | None = None) -> DataFrame:
    """``rows`` (doc_id, digest, ...) with ``next_<column>`` of the next row for each of the ``carried`` columns.

    Order: doc_id descending, nulls last, equal ids by digest; the first follows the last. Rows move
    once, to the stretch of their id, or of their id and digest where an id is crowded; the first row of a stretch is also sent to the stretch before.
    """
    if pieces is None:
        pieces = min(rows.count() // ROWS_PER_STRETCH + 1, MOST_STRETCHES)
    cuts, crowded = _cuts(rows, pieces)
    at = stretch_of(F.col("doc_id"), cuts)
    part = F.lit(0).cast("bigint")
    if crowded:
        parts = F.get(F.from_json(F.lit(json.dumps([crowded.get(i, 1) for i in range(len(cuts) + 2)])), "array<int>"), at)
        low, high = F.lit(float(LEAST_ID)), F.lit(-float(LEAST_ID))
        part = F.width_bucket(F.col("digest").cast("double"), low, high, parts)  # digests ascend from part to part
    at = F.struct(at.alias("s"), part.alias("p"))
    rank = F.struct(F.bitwise_not("doc_id").alias("n"), "digest")  # falls as the id grows, without overflow
    firsts = rows.groupBy(at.alias("stretch")).agg(F.min(rank).alias("first")).orderBy("stretch").collect()  # a row per stretch
    before = [firsts[i - 1]["stretch"] for i in range(len(firsts))]
    ghosts = rows.sparkSession.createDataFrame([(*f["first"], b) for f, b in zip(firsts, before)], "_n bigint, _digest bigint, _to struct<s:int,p:bigint>")
    sent = rows.join(F.broadcast(ghosts), F.bitwise_not("doc_id").eqNullSafe(F.col("_n")) & (F.col("digest") == F.col("_digest")), "left")  # a row per stretch
    own = F.struct(at.alias("stretch"), F.lit(False).alias("ghost"))
    copy = F.struct(F.col("_to").alias("stretch"), F.lit(True).alias("ghost"))
    sent = sent.select(*rows.columns, F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("_at"))
    order = Window.partitionBy("_at.stretch").orderBy("_at.ghost", F.col("doc_id").desc_nulls_last(), "digest")
    # Plain columns: an expression over them would travel next to them.
    return sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(~F.col("_at.ghost")).drop("_at")


def edited_fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, pieces: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text is the text with its last third replaced by as many characters from the start of
    the next document, in the order of ``with_next``; rows that repeat follow each other. A text is
    hashed before it moves, and it moves once.
    """
    lists = lexicon(docs, band)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_hashes(rows.withColumn("digest", F.xxhash64("text")), "text", lists, "hashes", fallback=True)
    if pieces is None:
        pieces = min(docs.count() // ROWS_PER_STRETCH + 1, MOST_STRETCHES)
    joined = with_next(rows, ["text", "hashes"], pieces).withColumn("size", F.length("text").cast("bigint"))
    third = F.floor(F.col("size") / 3).cast("int")
    kept = (F.col("size") - third).cast("int")
    joined = joined.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.substring(F.col("next_text"), F.lit(1), third)))
    joined = with_hashes(joined.select("doc_id", "size", "hashes", "edited", "next_hashes"), "edited", lists, "edited_hashes", fallback=True)
    return joined.select(
        "doc_id", F.col("size").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("hashes")).alias("fingerprint"), as_string(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
