"""Operators that look at a whole corpus, against plain versions on small tables."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tabloom.llm import gam, imatch, langid, mixing, near, simhash, token_scan, url_filter
from tests.llm.helpers import AWKWARD, corpus, rows_of, table
from tests.llm.test_texts import WORD, slow_fingerprint


def none_last(rows):
    return sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


# Token files

def test_token_scan_counts(spark, tmp_path):
    docs = table(spark, extra=True)
    encode = token_scan.tokenizer(token_scan.default_path()).encode_ordinary
    want = sorted(len(encode(r[1] or "")) for r in AWKWARD)
    for block in (16, 64, 1 << 18):  # documents span many blocks, or a block holds them all
        folder = str(tmp_path / str(block))
        token_scan.write_token_files(docs.repartition(3), folder, block=block)
        assert sorted(r["n_tokens"] for r in token_scan.count_tokens(spark, folder, block).collect()) == want
    assert token_scan.corpus_token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 4, 10])
def test_token_scan_of_any_sequence(spark, block):
    import random

    r = random.Random(block)
    rows, want = [], []
    for file in range(6):
        ids = [r.choice([0, 0, 5, 6, 7]) for _ in range(block * 4)]
        if file % 2:
            ids += [token_scan.PAD] * (block * r.randint(0, 2))
            ids[-1:] = [0]
        else:
            ids += [9] * r.randint(0, 3)  # no separator at the end
        ids += [token_scan.PAD] * (-len(ids) % block)
        data = np.array(ids, "<u2").tobytes()
        rows += [(f"f{file}", k, bytearray(data[2 * block * k:2 * block * (k + 1)])) for k in range(len(ids) // block)]
        start, found = 0, []
        for at, i in enumerate([*ids, None]):
            if i == 0 or i is None:
                part = ids[start:at]
                kept = [x for x in part if x != token_scan.PAD]
                if (i == 0 and (kept or not part)) or (i is None and kept):
                    found.append((start, len(kept)))
                start = at + 1
        want += [(f"f{file}", s, n) for s, n in found]
    blocks = spark.createDataFrame(rows, "file string, block bigint, data binary").repartition(4)
    assert rows_of(token_scan.documents_of(token_scan.scan_blocks(blocks)), "file", "start", "n_tokens") == sorted(want)


# Near duplicates

def slow_components(values, distance=4):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = list(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_components_of_dense_families(spark):
    import random

    r = random.Random(3)
    values = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            v = centre
            for b in r.sample(range(64), r.randint(0, 5)):
                v ^= 1 << b
            values.add(v)
    values |= {r.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, 1 << 63}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = simhash.link_components(spark.createDataFrame(signed, "fp bigint")).collect()
    groups = defaultdict(set)
    for row in got:
        groups[row["component"]].add(row["fp"] & ((1 << 64) - 1))
    want = defaultdict(set)
    for v, root in slow_components(values).items():
        want[root].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_ring_budgets_lose_no_pair(spark):
    """Every pair within the distance has a chain whose key and budgets it meets."""
    ring = simhash.Ring()
    import random

    r = random.Random(5)
    for _ in range(3_000):
        x = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        parts = [(x >> ring.offsets[i] & ((1 << ring.widths[i]) - 1)).bit_count() for i in range(5)]
        assert any(all(sum(parts[(i + k) % 5] for k in range(n + 1)) <= ring.budgets[n] for n in range(5)) for i in range(5))


def test_near_duplicates(spark):
    rows = [*AWKWARD, *[(100 + i, *r[1:]) for i, r in enumerate(corpus())]]
    prints = {r[1]: slow_fingerprint(r[1]) for r in rows}
    comp = slow_components(set(prints.values()))
    smallest = defaultdict(lambda: math.inf)
    for r in rows:
        if r[0] is not None:
            smallest[comp[prints[r[1]]]] = min(smallest[comp[prints[r[1]]]], r[0])
    want = [(r[0], f"{prints[r[1]]:016x}", smallest[comp[prints[r[1]]]] if smallest[comp[prints[r[1]]]] != math.inf else None) for r in rows]
    docs = table(spark, rows, extra=True)
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == none_last(want)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def slow_shingles(text):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_copies_of_similarity(spark):
    """One changed word in 60 leaves a similarity above 0.8, but often more than 4 different bits."""
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for k in range(60):
        words = [word() for _ in range(r.randint(40, 90))]
        texts.append(" ".join(words))
        for _ in range(k % 4):
            copy = list(words)
            for at in r.sample(range(len(words)), r.choice([1, 1, 2, 4])):
                copy[at] = word()
            texts.append(" ".join(copy))
    hub = [word() for _ in range(80)]
    texts += [" ".join([*hub[:i], word(), *hub[i + 1:]]) for i in range(80)]  # a large family
    r.shuffle(texts)
    sets = [slow_shingles(t) for t in texts]
    similar = lambda a, b: len(a & b) / len(a | b) >= 0.8
    want, seen = set(), set()
    for i in range(len(texts)):
        if i in seen:
            continue
        want.add(i)
        todo = [i]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += [j for j in range(len(texts)) if j not in seen and similar(sets[at], sets[j])]
    docs = table(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)], extra=True)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(i,) for i in sorted(want)]
    assert near.keep_one(docs.limit(0)).count() == 0


def test_one_row_per_component_whatever_the_ids(spark):
    a, b = "a first text of some seven words", "another text that has eight words in all"
    rows = [(5, a, "en", "x", 0), (1, b, "en", "x", 0), (5, b, "en", "y", 0), (1, b, "en", "x", 0), (None, a, "en", "z", 0), (None, "without an id", "en", "x", 0), (None, "without an id", "en", "x", 0),
            (None, None, "en", "x", 0), (7, "", "en", "x", 0)]
    kept = corpus_pipeline.simhash_near_dedup(spark, table(spark, rows), "")
    assert rows_of(kept, "doc_id", "text") == [(1, b), (5, a), (7, ""), (None, "without an id")]


# I-Match

@pytest.mark.parametrize("pieces", [None, 7, 60])
def test_edited_fingerprints(spark, pieces):
    rows = [*AWKWARD, *[(100 + i, *r[1:]) for i, r in enumerate(corpus())]]
    docs = table(spark, rows, extra=True)
    got = imatch.edited_fingerprints(docs, (0.01, 0.9), pieces).cache()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want, by_text = [], defaultdict(set)
    edits = {}
    for k, r in enumerate(order):
        text, following = r[1] or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        edits[digest] = edited
        want.append((r[0], len(text), digest))
    assert rows_of(got, "doc_id", "n_chars", "edited_sha256") == none_last(want)
    unique = {r[0]: r[1] or "" for r in rows}
    for r in got.collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[unique[r["doc_id"]]].add(r["fingerprint"])
        by_text[edits[r["edited_sha256"]]].add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in by_text.values())
    means = got.where("n_chars > 300").selectExpr("avg(near_edited) e", "avg(near_next) n").first()
    assert means["e"] > means["n"]
    assert imatch.edited_fingerprints(docs.limit(0)).count() == 0
    assert imatch.edited_fingerprints(docs.where("doc_id = 8")).count() == 1


def test_lexicon_band(spark):
    rows = [(i, " ".join(["all"] + ["half"] * (i % 2) + [f"only{i}"]), "en", "a", 0) for i in range(100)]
    docs = table(spark, rows)
    prints = imatch.fingerprint(docs, band=(0.3, 0.6)).collect()
    empty = {r["fingerprint"] for r in prints if r["doc_id"] % 2 == 0}
    other = {r["fingerprint"] for r in prints if r["doc_id"] % 2}
    assert len(empty) == len(other) == 1 and empty != other and next(iter(empty)) == "0000002a" * 64


def test_texts_that_meet_no_subset(spark):
    rows = [(i, f"unlike{i} other{i}" if i else "", "en", "a", 0) for i in range(40)] + [(50, "unlike7 other7", "en", "a", 0), (51, "other7  Unlike7", "en", "a", 0), (52, None, "en", "a", 0)]
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(table(spark, rows), (0.5, 0.9)).collect()}
    assert len({got[i]["fingerprint"] for i in range(40)}) == 40
    assert got[50]["fingerprint"] == got[51]["fingerprint"] == got[7]["fingerprint"]
    assert got[0]["fingerprint"] == got[52]["fingerprint"] == "0000002a" * 64
    assert got[51]["near_next"] == 1 and all(got[i]["near_next"] == 0 for i in range(1, 40))


# Mixing

def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Refill by weight until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_mix(spark):
    rows = [*AWKWARD, *[(100 + i, r[1], r[2], "big" if i % 3 else r[3], 0) for i, r in enumerate(corpus(400))], (900, "tiny one", "en", "Z", 0), (901, "ü b", "en", "ü", 0), (902, "", "en", "void", 0)]
    docs = table(spark, rows, extra=True)
    got = mixing.mix(docs).cache()
    assert rows_of(got, "doc_id", "size") == none_last([(r[0], len(WORD.findall(r[1] or ""))) for r in rows])
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = slow_targets(sizes)
    taken = defaultdict(int)
    for r in got.collect():
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        assert r["taken"] >= r["size"] * int(r["target"] // max(r["source_size"], 1) if r["source_size"] else 0)
        taken[r["source"]] += r["taken"]
    assert abs(taken["big"] - want["big"]) <= 3
    for s in want:
        assert abs(taken[s] - want[s]) <= max((len(WORD.findall(r[1] or "")) for r in rows if r[3] == s), default=0)
    key = ["doc_id", "source", "size", "nth", "taken"]
    assert rows_of(got, *key) == rows_of(mixing.mix(docs.repartition(5)), *key)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r["doc_id"]] += 1
    want_counts = defaultdict(int)
    for r in got.where("size > 0").collect():
        want_counts[r["doc_id"]] += r["taken"] // r["size"]
    assert counts == {k: v for k, v in want_counts.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_mix_follows_the_rank(spark):
    """With documents of one size, the sample of a source is exactly the first of its rank."""
    rows = [(i, "w w w", "en", f"s{i % 2}", 0) for i in range(600)]
    got = mixing.mix(table(spark, rows)).collect()

    def odds(i, left):
        u = (int(hashlib.md5(f"{i}/1".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return u / (1 - u) / (left / (1 - left))

    for s in ("s0", "s1"):
        mine = [r for r in got if r["source"] == s]
        share = mine[0]["target"] / mine[0]["source_size"]
        whole = int(share)
        order = sorted(mine, key=lambda r: odds(r["doc_id"], share - whole))
        fit = int((mine[0]["target"] - whole * mine[0]["source_size"]) // 3)
        extra = {r["doc_id"] for r in mine if r["taken"] > whole * 3}
        assert {r["doc_id"] for r in order[:fit]} <= extra and len(extra) <= fit + 1


# Language and quality

def test_language(spark):
    rows = corpus(600)
    docs = table(spark, [*rows, *[(None if r[0] is None else 10_000 + r[0], *r[1:]) for r in AWKWARD]], extra=True)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r[0]: r[2] for r in rows if len(r[1]) > 60}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 50 and sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all((got[i + 10_000]["lang_pred"], got[i + 10_000]["score"]) == ("und", 0.0) for i in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {10_001, 10_002, 10_003} & {r["doc_id"] for r in kept.collect()}
    assert kept.count() >= 0.97 * len(rows)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = {"a": 0, "b": 1, "ab": 2, "ba": 3, "▁a": 4, "aba": 5}
    prob = langid.with_unknown(np.array([[1, 2], [2, 1], [3, 1], [1, 1], [2, 2], [4, 1.0]]))

    def all_ways(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(word) + 1):
            p = pieces.get(word[:k], len(pieces) if k == 1 else None)
            if p is not None:
                total = total + prob[p] * all_ways(word[k:])
        return total

    words = ["▁a", "▁abab", "aba", "▁xyz", "▁ababab"]
    lattice = langid.Lattice(words, langid.Tables(pieces))
    got = lattice.totals(lattice.forward(prob))
    assert np.allclose(got, [all_ways(w) for w in words], rtol=1e-12)
    uses = lattice.expected(prob, np.ones((len(words), 2)))
    letters = sum(uses[p].sum() * len(w) for w, p in pieces.items()) + uses[len(pieces)].sum()
    assert letters == pytest.approx(2 * sum(map(len, words)))  # expected pieces cover every character once


def test_quality(spark):
    import random

    r = random.Random(2)
    rows, labels = [], []
    for i, row in enumerate(corpus(600)):
        bad = i % 4 == 0
        text = " ".join(w + r.choice(["***", "$$$", "&&&"]) for w in row[1].split()) if bad and i % 8 else row[1].upper() + "!!" * 40 if bad else row[1]
        rows.append((i, text, *row[2:]))
        labels.append((i, int(not bad), 0))
    docs = table(spark, [*rows, *[(None if a[0] is None else 10_000 + a[0], *a[1:]) for a in AWKWARD]], extra=True)
    frame = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (99_999, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x for x in gam.classify(docs, frame).collect()}
    held = [i for i, q, _ in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())
    assert gam.keep_good(docs, frame).columns == docs.columns
    assert gam.classify(docs.limit(0), frame).count() == 0
    assert {x["score"] for x in gam.classify(docs, frame.limit(0)).collect()} == {0.5}


def test_model_is_a_sum_of_tables():
    r = np.random.default_rng(0)
    x = r.normal(size=(2_000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(2_000) < 0.02)).astype(float)  # only the pair of features tells
    model = gam.fit(x, y)
    assert (0, 1) in model.pairs
    p = model.score(x)
    assert ((p > 0.5) == y).mean() > 0.9
    total = model.intercept + sum(t[np.searchsorted(e, x[:, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
    for (i, j), t in model.pairs.items():
        total = total + t[np.searchsorted(model.coarse[i], x[:, i], side="right"), np.searchsorted(model.coarse[j], x[:, j], side="right")]
    assert np.allclose(p, 1 / (1 + np.exp(-total)))


# URLs

PAGES = [
    (1, "http://A.Example.org/en/1?x=1#f", None), (2, "https://x.net/a", "<LINK rel='canonical' href=\"http://shop.example.com/de/9\">"),
    (3, "http://shop.example.com/de/9", ""), (4, "http://y.net/r?utm_source=q", '<meta http-equiv="refresh" content="0; url=https://x.net/a/">'),
    (5, "https://y.net/r#t", None), (6, None, None), (7, "nourl", None), (8, "http://z.net/b", "<link href=http://q.org/x rel=canonical>"),
    (9, "http://z.net/c", '<link rel="canonical" href="/b"><link rel="canonical" href="http://shop.example.com/de/7">'),
    (10, "http://example.org/es/1", None), (11, "ftp://example.com/fr/", None), (12, "http://xexample.org/es/1", None), (13, "http://org", None),
    (13, "http://org", None), (14, "http://lone.net/q", '<link rel="canonical" href="c">'), (15, "http://lone.net/c?b", None),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' as node", "'y' as host", "'z' as links")
    got = rows_of(url_filter.judge(pages), "page_id", "host", "path", "rule", "verdict")
    assert got == none_last([
        (1, "a.example.org", "/en/1", "example.org/en/1", "block"), (2, "x.net", "/a", None, "block"), (3, "shop.example.com", "/de/9", "com/de/", "block"),
        (4, "y.net", "/r", None, "block"), (5, "y.net", "/r", None, "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "z.net", "/b", None, "allow"),
        (9, "z.net", "/c", None, "allow"), (10, "example.org", "/es/1", "example.org/es/", "block"), (11, "example.com", "/fr/", "com/fr/", "allow"),
        (12, "xexample.org", "/es/1", "org/", "allow"), (13, "org", "", None, "allow"), (13, "org", "", None, "allow"), (14, "lone.net", "/q", None, "allow"), (15, "lone.net", "/c", None, "allow")])
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_known_redirects_and_no_python(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    known = spark.createDataFrame([("http://lone.net/c?b", "http://gone.net/1"), ("http://gone.net/1", "https://w.com/de/1")], "url string, target string")
    judged = url_filter.judge(pages, redirects=known)
    assert {r["page_id"]: r["verdict"] for r in judged.collect()}[15] == "block"
    for frame in (judged, imatch.edited_fingerprints(table(spark))):
        assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()


def test_rules_that_end_where_an_uncrawled_target_does(spark):
    canonical = "<link rel=canonical href='%s'>"
    pages = spark.createDataFrame([
        (1, "http://a.net/1", canonical % "https://shop.com/de/"), (2, "http://b.net/1", canonical % "https://shop.com:443/de/?utm_source=x"),
        (3, "http://c.net/1", canonical % "https://x.org/" + canonical % "https://shop.com/de/1"),  # the allow of org/ outranks
        (4, "http://d.net/1", canonical % "https://a.example.org/es/"), (5, "http://e.net/1", canonical % "https://other.com/de"),
        (6, "http://f.net/1", None), (7, "http://g.net/1", None)], "page_id bigint, url string, html string")
    known = spark.createDataFrame([("http://f.net/1", "https://w.com/de/"), ("https://v.com/de/", "http://g.net/1")], "url string, target string")
    got = rows_of(url_filter.judge(pages, redirects=known), "page_id", "rule", "verdict")
    assert got == [(1, None, "block"), (2, None, "block"), (3, None, "allow"), (4, None, "block"), (5, None, "allow"), (6, None, "block"), (7, None, "block")]
