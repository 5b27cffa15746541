"""Operators that look at one text at a time, against plain versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import bpe, html_text, rules, simhash, textstats
from tests.llm.helpers import corpus, rows_of, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.one_of(st.sampled_from("ab AB.\n\t'#|é ßΣñ日́"), st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"])), max_size=80)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(bpe.default_path()))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_bpe_like_the_library(library, encoder, texts):
    for text, (ids, decoded) in zip(texts, encoder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_special_tokens_long_words_and_empty(library, encoder):
    for text in ["", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> ΑΣ ΣΑΣ İ", "aaaaaaaaab" * 500, "'s 'LL it's\x1c\x85\xa0x", "½²³ ١٢ ⅷ"]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0][0], "<u4").tolist() == want


def test_bpe_leftmost_merges_where_the_table_is_not_ordered(encoder):
    v = bpe.load(bpe.default_path())
    words = ["hellohello", "aaaa", "thethethe", "x"]
    fast, begin = v.encode_words(words)
    v.ordered = False
    slow, begin2 = v.encode_words(words)
    assert fast.tolist() == slow.tolist() and begin.tolist() == begin2.tolist()


def test_bpe_documents(spark, library):
    docs = table(spark, extra=True)
    got = rows_of(bpe.encode_documents(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for doc_id, text, *_ in table(spark).collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_bpe_round_trip_of_ids(spark):
    rows = bpe.encode_documents(table(spark), texts=True).dropDuplicates(["doc_id"]).cache()
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(rows).collect()}
    assert back == {r["doc_id"]: r["decoded"] for r in rows.collect()}


def slow_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = [r[1] or "" for r in table_rows()] + [r[1] for r in corpus()]
    assert simhash.fingerprint_texts([t.encode() for t in texts]).tolist() == [slow_fingerprint(t) for t in texts]


def test_fingerprints_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    monkeypatch.setattr(simhash, "FLUSH", 20)
    texts = [r[1] for r in corpus(40)]
    assert simhash.fingerprint_texts([t.encode() for t in texts]).tolist() == [slow_fingerprint(t) for t in texts]


def table_rows():
    from tests.llm.helpers import AWKWARD

    return AWKWARD


def slow_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


def test_measures_and_policies(spark):
    rows = [*table_rows(), *[(i, t, lang, s, n) for i, t, lang, s, n in corpus()], (500, "a b c d e a b c d e f\nx\nx\n x", "en", "a", 1), (501, "r " * 30, "en", "a", 1)]
    docs = table(spark, rows, extra=True)
    ledger = rules.ledger(docs).cache()
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = [(r[0], *slow_measures(r[1])) for r in rows]
    assert rows_of(ledger, "doc_id", *base) == sorted(want, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    kept = rules.apply_policy(ledger, "base").collect()
    assert all(r["kept"] == (not (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])) for r in kept)
    for row in rules.ablations(ledger).collect():
        mask, bit = rules.bits_of(rules.POLICIES[row["version"]]), rules.bits_of([row["rule"]])
        bits = [r["failed"] & mask for r in kept]
        assert (row["kept"], row["failed"], row["only_this"], row["kept_without"]) == (
            bits.count(0), sum(b & bit != 0 for b in bits), bits.count(bit), sum(b & ~bit == 0 for b in bits))
    assert rules.ledger(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), max_size=5))
def test_repeated_windows(texts):
    want = [slow_measures(b" ".join(t).decode())[4] for t in texts]
    assert textstats.repeated_windows(texts).tolist() == want


def test_html_layout():
    page = """<html><head><title>x</title></head><body><h1>Head  line</h1>Intro<p>One <b>two</b>
 three<p>Four<br>five<ul><li>a<li>b <ol start=3><li>x<li>y</ol></li><li>c</ul>tail
<table><tr><th>Name<th>N<tr><td>Longer name<td>1<tr><td>日本<td>2</table>after <pre>  keep
    this</pre><div hidden>no</div><span style="display: none">no</span> 1 < 2 &amp; 3<script>var a="</p>"</script><!-- c --></div></span> end<p>"""
    assert html_text.text_of(page).split("\n") == [
        "Head line", "", "Intro", "", "One two three", "", "Four", "five", "", "- a", "- b", "  3. x", "  4. y", "- c", "", "tail", "",
        "Name         N", "Longer name  1", "日本         2", "", "after", "", "  keep", "    this", "", "1 < 2 & 3 end"]


def test_html_formulas_and_drawings():
    page = """a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding="tex">no</annotation><annotation-xml>no</annotation-xml></math> b
<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><path d="M0"/><defs/><text>Label</text><text>two <tspan>three</tspan></text></svg> <desc>c</desc>"""
    assert html_text.text_of(page) == "a x=2 b Label two three c"


def test_html_cells_of_several_rows():
    page = "<table><caption>T<tr><th rowspan=2>A<th>B<th rowspan='0'>C<tr><td>b2<td>d2<tr><td>a3<td>b3<td>d3<tbody><tr><td>x<td>y<td>z</table>"
    assert html_text.text_of(page).split("\n") == ["T", "A   B   C", "    b2     d2", "a3  b3     d3", "x   y   z"]


def test_html_comment_without_end():
    assert html_text.text_of("<p>seen</p><!-- <b>no</b> tail") == "seen"
    assert html_text.text_of("a<!-->b<!--->c<!-- no -->d<!-- no --!>e") == "abcde"


@settings(max_examples=300, deadline=None)
@given(st.text("<>pliu/td r\"'&;!-abc", max_size=60))
def test_html_never_fails(page):
    html_text.text_of(page)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<td>", "<tr>", "</table>", "<div>", "</div>", "<br>", "<ol>", "</ol>", "<pre>", "<caption>", "</td>", "<th>"]), max_size=30))
def test_html_keeps_all_visible_words(tags):
    page = "".join(f"{t}w{i} " for i, t in enumerate(tags))
    assert sorted(re.findall(r"w\d+", html_text.text_of(page))) == sorted(f"w{i}" for i in range(len(tags)))


def test_html_depth_and_rows(spark):
    assert html_text.text_of("<div>" * 50_000 + "x").strip() == "x"
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>a"), (3, "u", "<p>a")], "page_id bigint, url string, html string")
    assert rows_of(html_text.extract(df.selectExpr("*", "'x' as text")), "page_id", "text", "n_chars", "n_lines") == [(1, "", 0, 0), (2, "", 0, 0), (3, "a", 1, 1), (3, "a", 1, 1)]
    assert html_text.extract(df.limit(0)).count() == 0
