"""Quality rules: a ledger of failure bits and measurements, policies on top of it, and ablations.

Every rule is evaluated once per text. The ledger holds the measurements and one bit per failed
rule; a policy is a version with the set of rules it applies, so a new policy or an ablation needs
the ledger only, not the texts. Ledgers are aggregated by their bits before anything is counted.

Nulls and empties: a null text counts as empty; it fails the rules that ask for words. Texts are read
whole; repeated rows and ids give a row each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.blocks import as_bytes, map_blocks, texts_of
from tabloom.llm.textstats import Flat, repeated_windows, table_of

SYMBOLS = table_of("#*$%&|<>")
UPPER = table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SHOUTS = table_of("!")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts"]


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; the position in RULES is the bit."""

    name: str
    fails: str


RULES = [
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("upper_case", "2 * n_upper > word_chars"),
    Rule("shouting", "3 * n_shouts > n_words and n_words > 0"),
]

#: Which rules a policy version applies.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "duplicate_lines"],
    "v2": [r.name for r in RULES],
}


def bits_of(names: list[str]) -> int:
    order = [r.name for r in RULES]
    return sum(1 << order.index(n) for n in names)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every text."""

    def make():
        def work(block: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(block.column("text"))
            flat = Flat(texts)
            n_words, word_chars = flat.words()
            lines = [[x for x in t.split(b"\n") if x.strip(b" \t\n\v\f\r")] for t in texts]
            n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
            distinct = np.fromiter((len(set(x)) for x in lines), np.int64, len(lines))
            repeats = repeated_windows([t.split() for t in texts])
            values = [n_words, word_chars, flat.total(SYMBOLS[flat.data]), n_lines - distinct, repeats, n_lines,
                      flat.total(UPPER[flat.data]), flat.total(SHOUTS[flat.data])]
            return pa.RecordBatch.from_arrays([block.column("doc_id"), *[pa.array(v.astype(np.int64)) for v in values]], ["doc_id", *MEASURES])

        return work

    return map_blocks(texts_of(docs, "doc_id"), make, "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))


def failure_bits() -> Column:
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements and ``failed`` (bits of the failed rules) of every text."""
    return measure(docs).withColumn("failed", failure_bits())


def apply_policy(rows: DataFrame, version: str = "v2", name: str = "kept") -> DataFrame:
    """``name``: no rule of the policy failed."""
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(bits_of(POLICIES[version]))) == 0)


def ablations(rows: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """(version, rule, kept, failed, only_this, kept_without) per policy and rule.

    The ledger is first grouped by its bits (at most 2 to the number of rules), so what follows does
    not grow with the documents. ``kept_without``: rows kept if the policy left the rule out.
    """
    grouped = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    entries = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(bits_of(POLICIES[v])).cast("bigint").alias("mask"), F.lit(bits_of([r])).cast("bigint").alias("bit"))
               for v in versions or POLICIES for r in POLICIES[v]]
    each = grouped.select("n", "failed", F.inline(F.array(*entries)))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return each.groupBy("version", "rule").agg(
        count(hit == 0).alias("kept"),
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("failed"),
        count(hit == F.col("bit")).alias("only_this"),
        count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )
