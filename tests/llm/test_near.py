"""Passes of the pipeline's near-copy stage, each against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import near
from tests.llm.helpers import COLUMNS, table


def jaccard(a, b):
    return len(a & b) / len(a | b)


def family(r, n, words=60, changed=3, tag="w"):
    """Texts from one base with ``changed`` random words each: similarities of 0.4 to 0.7 among them."""
    base = [f"{tag}{i}" for i in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in r.sample(range(words), changed):
            copy[at] = f"n{r.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def shingle_set(text):
    return frozenset(near.shingles_of(text.encode(), 5).tolist())


def test_fingerprints_of_sets():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(n % 2)) for n in (1, 2, 3, 200, 130_000, 5)]
    for s, fp in zip(sets, near.simhash_of(sets).tolist()):
        bits = [(2 * int(((s >> np.uint64(b)) & np.uint64(1)).sum()) > len(s)) << b for b in range(64)]
        assert fp == sum(bits)


@pytest.mark.parametrize("few", [near.FEW, 3])
def test_prefixes_lose_no_pair(spark, few):
    """Token pairs, with components all different, hold every pair at 0.8 or more."""
    r = random.Random(few)
    sets = []
    for _ in range(40):
        base = [r.randrange(10**6) for _ in range(r.choice([1, 2, 5, 9, 10, 30]))]
        for _ in range(4):
            sets.append(sorted({x if r.random() < 0.93 else r.randrange(10**6) for x in base} | {r.randrange(50)}))
    df = spark.createDataFrame(list(enumerate(sets)), "node bigint, shingles array<bigint>")
    entries = near.prefixes(df, 0.8).withColumn("comp", F.col("node"))
    found = {frozenset(p) for p in near._token_pairs(entries, 0.8).collect()}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i]), set(sets[j])) >= 0.8}
    assert len(want) > 20 and want <= found
    kept = {frozenset(p) for p in near._links(spark.createDataFrame([tuple(p) for p in found], "u bigint, v bigint"), df, 0.8).collect()}
    assert kept == want


def test_family_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    texts = family(random.Random(1), 400)
    formed = []
    links = near._links
    monkeypatch.setattr(near, "_links", lambda pairs, *rest: (formed.append(pairs.count()), links(pairs, *rest))[1])
    kept = near.keep_one(table(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)]))
    assert kept.count() == len({shingle_set(t) for t in texts})
    assert sum(formed) < 4 * len(texts)


def test_recall_at_the_threshold(spark):
    """Pairs of 0.8 to 0.85: all but a few of the copies go, and nothing below 0.8."""
    r = random.Random(9)
    rows, pairs = [], []
    for k in range(300):
        words = [f"v{r.randrange(10**6)}" for _ in range(r.randint(60, 200))]
        copy = list(words)
        while True:
            trial = list(copy)
            trial[r.randrange(len(trial))] = f"u{r.randrange(10**9)}"
            if jaccard(shingle_set(" ".join(words)), shingle_set(" ".join(trial))) < 0.8:
                break
            copy = trial
        rows += [(2 * k, " ".join(words), "en", "a", 0), (2 * k + 1, " ".join(copy), "en", "b", 0)]
        if copy != words:
            pairs.append(k)
    kept = {x.doc_id for x in near.keep_one(table(spark, rows)).collect()}
    assert {2 * k for k in range(300)} <= kept
    caught = [k for k in pairs if 2 * k + 1 not in kept]
    assert len(pairs) > 250 and len(caught) >= 0.99 * len(pairs)


def test_clashing_and_map_columns(spark):
    docs = table(spark, [(1, "a b c d e f", "en", "a", 0), (2, "a b c d e f", "en", "a", 0), (1, "a b c d e f", "en", "a", 0), (None, None, None, None, None)])
    docs = docs.withColumn("_digest", F.lit("x")).withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("a.b", F.lit(1))
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert near.keep_one(spark.createDataFrame([], COLUMNS)).count() == 0
