"""The manifest against a tree built in plain Python, on small and awkward tables."""

import hashlib
import zlib

import pytest

from tabloom.llm import merkle
from tests.llm.helpers import AWKWARD, COLUMNS, EXTRA, table


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        first = at // 16 * 16
        yield level[first:at], level[at + 1:first + 16]
        at //= 16


def slow(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) per row, sorted."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        fields = [field(x) for x in (doc_id, source, lang, n_chars)]
        leaf = H(*fields, field(text))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        changed = H(*fields, field(text and text.translate(low))) if hit else leaf
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, changed))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (_, doc_id, leaf, h) in enumerate(sorted(groups[s])):
            steps = [*siblings(trees[s], i), *siblings(top, j)]
            for left, right in steps:
                h = H(*left, h, *right)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], H(*[x for a, b in steps for x in a + b]), h, h == top[-1][0]))
    return sorted(out, key=str)


def many():
    """One source holds most rows; 20 more have one row each; one has 17 rows, so the last run holds one node."""
    rows = [(i, f"Text {i} Ä", "en", "hot", i) for i in range(300)]
    rows += [(1000 + i, "one", None, f"s{i}", None) for i in range(20)]
    return rows + [(2000 + i, None if i % 3 else "X", "de", "é", i) for i in range(17)]


@pytest.mark.parametrize("rows", [AWKWARD, many(), [(7, "Lone", "en", None, 4)], [(3, "A", "x", "y", 1)] * 40], ids=["awkward", "many", "lone", "repeated"])
def test_proofs(spark, rows):
    got = merkle.prove_documents(table(spark, rows, extra=True)).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow(rows)


def test_tampering_shows(spark):
    docs = table(spark, many())
    got = {r.doc_id: r.verified for r in merkle.prove_documents(docs).collect()}
    assert {i for i, ok in got.items() if not ok} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0} | {
        i for i in range(2000, 2017, 3) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_empty(spark):
    df = merkle.prove_documents(spark.createDataFrame([], COLUMNS))
    assert df.collect() == [] and df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_other_columns_and_fan_out(spark):
    """A general table: payload columns come back, a fan-out of 2 gives deep trees that the jumps cover."""
    leaves = spark.createDataFrame([(g, i, H(g, str(i)), i * 2) for g in "ab" for i in range(37 if g == "a" else 5)], "grp string, pos bigint, leaf string, other bigint")
    got = merkle.manifest(leaves, "grp", "pos", fan_out=2)
    assert set(got.columns) == {"grp", "pos", "leaf", "other", "subroot", "root", "path"} and not set(got.columns) & set(EXTRA)
    rows = got.withColumn("again", merkle.fold(got.leaf, got.path)).collect()
    assert len(rows) == 42 and all(r.again == r.root and r.other == 2 * r.pos for r in rows)
    assert {(r.grp, len(r.path)) for r in rows} == {("a", 7), ("b", 4)}  # 37 -> 6 levels, 5 -> 3, and one above


def test_stored_partitions_follow_the_nodes(spark, monkeypatch):
    """Levels and pointers of a deep tree are stored in few partitions, which do not double with every jump."""
    stored = []

    def cut(df, real=merkle.cut_lineage):
        out = real(df)
        stored.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(merkle, "cut_lineage", cut)
    leaves = spark.createDataFrame([("a", i, H(str(i))) for i in range(300)] + [("b", 0, H("b"))], "grp string, pos bigint, leaf string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle.manifest(leaves, "grp", "pos", fan_out=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = got.withColumn("again", merkle.fold(got.leaf, got.path)).collect()
    assert len(rows) == 301 and all(r.again == r.root for r in rows)
    assert max(stored) <= 10  # 300 rows give nine levels, the two subroots one more; 8 shuffle partitions
    assert sum(x > 1 for x in stored) <= 7  # runs, subroots, pointers of all levels, four jumps


def test_levels_in_many_partitions(spark, monkeypatch):
    """Levels of more nodes than a task takes in, and more targets than may be broadcast."""
    monkeypatch.setattr(merkle, "NODES", 3)
    monkeypatch.setattr(merkle, "TARGETS", 1)
    rows = many() + [(3000 + i, str(i), "en", f"t{i % 3}", i) for i in range(200)]
    got = merkle.prove_documents(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow(rows)
