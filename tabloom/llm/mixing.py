"""Mixing sources to target weights: whole copies first, then a Pareto order sample of fixed size.

The size of a document is its number of words. Sources in code point order (null last) carry the
given weights in turn and share all words; a target stops at ``most`` times its source's size and the
excess goes to the others by weight. Every document of a source gets as many whole copies as the
target allows all of them; what is left is one more copy of some documents. These are ranked by
random odds divided by inclusion odds (Pareto order sampling; the inclusion odds follow the left
share and the document's preference), and the first in rank that fit are taken, in two passes. Last, the one
document that closes the remaining gap best is added, if that brings the source nearer to its target.

The rank is cut without sorting a source: sizes are summed in fine slices of the rank, and only the
slice that holds the cut is ordered row by row. Tables with a row per source are broadcast after a
check of their size, so that a source with very many documents is not gathered in one task. Random numbers are digests of the document's id, so
reruns agree; rows that repeat are drawn one by one.

Nulls and empties: a null or empty text has size 0 and is never taken; null sources are one source,
null ids are documents like others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.blocks import fresh
from tabloom.session import broadcast_if_small, cut_lineage

SLICES = 1 << 14  # slices of the rank; the cut orders one of them
TEXT_SLICES = 256  # slices that rows of one id, source and size are dealt to
CHUNK = 10_000  # rows that are numbered at a time
PASSES = 2  # passes down the rank; the second uses the gap that a large document left at the first cut


def text_slice(text: Column) -> Column:
    """Slice of a text by its digest."""
    return F.pmod(F.xxhash64(text), F.lit(TEXT_SLICES)).cast("int")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, place, source_size, n_docs, target) from (source, size): one row per source.

    The level at which sources are filled is found by a running sum over sources in the order in which
    they reach their limit.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights))
    per = per.withColumn("weight", weight.cast("double")).withColumn("limit", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    full = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - full) / open_weight
    filled = per.withColumn("level", level)
    holds = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "place", "level"))
    filled = filled.withColumn("level", F.min(holds).over(everything)["level"])
    return filled.select("source", "place", "source_size", "n_docs", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def _first_that_fit(rows: DataFrame) -> DataFrame:
    """One pass down the rank: of the rows not yet taken and no larger than ``open``, the first whose sizes add up to
    at most ``open`` are taken; ``open`` is lowered by what they hold.
    """
    may = ~F.col("extra") & (F.col("size") <= F.col("open"))
    by_slice = Window.partitionBy("place").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.where(may).groupBy("place", "slice", "open").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(by_slice), F.lit(0)))
    over = sums.where(F.col("before") + F.col("words") > F.col("open"))
    cuts = over.groupBy("place").agg(F.min(F.struct("slice", "before")).alias("at")).select("place", F.col("at.slice").alias("cut"), "at.before")
    marked = rows.join(broadcast_if_small(cut_lineage(cuts)), "place", "left")
    at_cut = may & F.col("cut").isNotNull() & (F.col("slice") == F.col("cut"))
    running = Window.partitionBy("place").orderBy("rank", "doc_id", "size", "nth")
    inside = marked.where(at_cut).withColumn("now", F.col("before") + F.sum("size").over(running) <= F.col("open"))
    outside = marked.where(~at_cut).withColumn("now", may & F.coalesce(F.col("slice") < F.col("cut"), F.lit(True)))
    both = cut_lineage(inside.unionByName(outside).drop("cut", "before"))
    held = both.groupBy("place").agg(F.coalesce(F.sum(F.when(F.col("now"), F.col("size"))), F.lit(0)).cast("double").alias("held"))
    both = both.join(broadcast_if_small(cut_lineage(held)), "place").withColumns({"open": F.col("open") - F.col("held"), "extra": F.col("extra") | F.col("now")})
    return both.drop("held", "now")


def draw(units: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``units`` (doc_id, source, size, nth) with their source's figures and ``taken`` words."""
    share = F.col("target") / F.col("source_size")
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(share)).otherwise(F.lit(0)).cast("bigint"))
    plan = plan.withColumn("open", F.col("target") - (F.col("copies") * F.col("source_size")).cast("double"))
    plan = cut_lineage(plan.withColumn("left", F.when(F.col("source_size") > 0, share - F.col("copies")).otherwise(F.lit(0.0))))
    slim = plan.select(F.col("source").alias("_source"), "place", "source_size", "n_docs", "target", "copies", "open", "left")
    rows = units.join(broadcast_if_small(slim), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    label = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("nth").cast("string"))
    uniform = (F.conv(F.substring(F.md5(label), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    # Preference: documents longer than the mean of their source come a little sooner, shorter ones later.
    preference = F.least(F.greatest(F.col("size") * F.col("n_docs") / F.col("source_size"), F.lit(0.25)), F.lit(4.0))
    odds = preference * F.col("left") / (1 - F.col("left"))
    rows = rows.withColumn("rank", F.when((F.col("size") > 0) & (F.col("left") > 0), uniform / (1 - uniform) / odds))
    rows = cut_lineage(rows.withColumn("slice", F.floor(F.col("rank") / (1 + F.col("rank")) * SLICES)))
    picked = rows.where(F.col("rank").isNotNull()).withColumn("extra", F.lit(False))
    for _ in range(PASSES):
        picked = cut_lineage(_first_that_fit(picked))
    fills = picked.where(~F.col("extra")).withColumn("miss", F.abs(F.col("size") - F.col("open"))).where(F.col("miss") < F.col("open"))
    fills = fills.groupBy("place").agg(F.min(F.struct("miss", "rank", "doc_id", "nth", "size")).alias("fill"))
    picked = picked.join(broadcast_if_small(cut_lineage(fills)), "place", "left")
    filled = F.col("fill").isNotNull() & F.col("doc_id").eqNullSafe(F.col("fill.doc_id")) & (F.col("nth") == F.col("fill.nth")) & (F.col("size") == F.col("fill.size"))
    picked = picked.withColumn("extra", F.col("extra") | F.coalesce(filled, F.lit(False))).drop("fill")
    out = picked.unionByName(rows.where(F.col("rank").isNull()).withColumn("extra", F.lit(False)))
    return out.withColumn("taken", F.col("size") * (F.col("copies") + F.col("extra").cast("bigint")))


def units_of(docs: DataFrame, sliced: bool = False) -> DataFrame:
    """(doc_id, source, size, nth) per row, stored; rows that repeat are numbered by ``nth``.

    With ``sliced``, also ``text_slice``, and ``place_in_slice`` from 0: rows of one key are numbered slice of texts by slice.
    """
    key = ["doc_id", "source", "size"]
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_slice(F.col("text")).alias("text_slice"))
    named = [*key, "text_slice"] if sliced else key
    equal = slim.groupBy(*named).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*key).orderBy("text_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most TEXT_SLICES rows
    equal = equal.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) if sliced else F.lit(0))
    # Two steps, so that no array is as long as the rows of a key are many.
    equal = equal.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK))).alias("low"))
    last = F.least(F.col("low") + CHUNK, F.col("n")) - 1
    units = equal.select(*named, "before", F.explode(F.sequence("low", last)).alias("place_in_slice"))
    units = units.withColumn("nth", (F.col("before") + F.col("place_in_slice") + 1).cast("int")).drop("before")
    return cut_lineage(units if sliced else units.drop("place_in_slice"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(doc_id, source, size, nth, source_size, target, taken) of every row of ``docs``."""
    units = units_of(docs)
    return draw(units, targets(units, weights, most)).select("doc_id", "source", "size", "nth", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them. Rows of equal id, source and size are numbered within a slice of
    their texts, where the texts meet the decisions; so texts are moved once, and a repeated or null id spreads over TEXT_SLICES
    groups. Only rows that repeat their text, too, share one.
    """
    key, nth, times, copy = (fresh(docs, n) for n in ("mix_key", "mix_nth", "mix_times", "mix_copy"))
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    units = units_of(docs, sliced=True)
    name = F.to_json(F.struct("doc_id", "source", "size", "text_slice")).alias(key)
    decided = draw(units, targets(units, weights, most)).select(name, F.struct("nth", copies.alias("copies")).alias("d"))
    decided = decided.groupBy(key).agg(F.sort_array(F.collect_list("d")).alias("all")).select(key, F.col("all.copies").alias(times))
    text = F.col("text")
    named = docs.withColumn(key, F.to_json(F.struct("doc_id", "source", n_words(text).alias("size"), text_slice(text).alias("text_slice"))))
    rows = named.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).join(decided, key)
    wanted = F.get(times, F.col(nth) - 1)
    return rows.where(wanted > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), wanted)).alias(copy)).drop(copy)
