"""The inverted multi-index against all pairs, on small tables."""

import math

import numpy as np
import pytest

from tabloom.llm import multi_index

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, home int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


def slow(rows, threshold=0.9):
    """Sorted (vec_id, n_links, component_id, kept) from all pairs."""
    units = []
    for _, v in rows:
        ok = v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x = np.array(v, np.float32).astype(float) if ok else None
        units.append(None if x is None else x / np.linalg.norm(x))
    near = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold] for i, a in enumerate(units)]
    out, name = [], {}
    for i in range(len(rows)):
        if i not in name:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            name.update(dict.fromkeys(group, min(ids) if ids else None))
        out.append((rows[i][0], len(near[i]), name[i], rows[i][0] == name[i]))
    return sorted(out, key=str)


def families(seed=5, d=24):
    """Unrelated vectors, chains, exact copies and a large family whose pairs lie on both sides of the threshold."""
    r = np.random.default_rng(seed)
    rows = [r.normal(size=d) for _ in range(400)]
    for at, size, noise in ((0, 150, 0.33), (1, 40, 0.25), (2, 20, 0.5)):
        rows += [rows[at] + noise * r.normal(size=d) for _ in range(size)]
    for _ in range(30):
        rows.append(rows[-1] + 0.3 * r.normal(size=d))
    rows += [rows[3]] * 50
    order = r.permutation(len(rows))
    return [(int(i) * 3, [float(c) for c in rows[j]]) for i, j in enumerate(order)]


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("slice_rows", [multi_index.SLICE_ROWS, 40])
def test_all_pairs(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(multi_index, "SLICE_ROWS", slice_rows)  # heavy blocks in several tasks
    monkeypatch.setattr(multi_index, "CELL_ROWS", 8)
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 16)
    rows = families()
    mine, want = got(multi_index.near_duplicates(frame(spark, rows))), slow(rows)
    found, there = sum(r[1] for r in mine), sum(r[1] for r in want)
    assert there > 5_000 and found >= 0.999 * there
    assert all(a[1] <= b[1] for a, b in zip(mine, want))  # none below the threshold, none twice
    assert sum(a[2] == b[2] for a, b in zip(mine, want)) >= 0.995 * len(want)


def test_depth_is_calibrated():
    r = np.random.default_rng(1)
    x = r.normal(size=(3_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = multi_index.fit(x, 20_000, 0.9, 0.99)
    assert 1 < index.depth < index.k**2
    y = 0.9 * x + (1 - 0.81) ** 0.5 * (lambda z: z / np.linalg.norm(z, axis=1)[:, None])((z := r.normal(size=x.shape)) - np.einsum("ij,ij->i", z, x)[:, None] * x)
    (hx, vx), (hy, vy) = index.place(x), index.place(y)
    met = [hy[i] in vx[i] or hx[i] in vy[i] for i in range(len(x))]
    assert np.mean(met) >= 0.98
    a, b = index.distances(x[:20])  # the places visited are those of a plain sort of the product grid
    for row in range(20):
        cells = sorted((a[row, i] + b[row, j], i, j) for i in range(index.k) for j in range(index.k))[: index.depth]
        assert {int(index.block(np.array(i), np.array(j))) for _, i, j in cells} == set(vx[row].tolist())


def test_awkward(spark):
    rows = [(1, None), (2, [0.0] * 4), (3, [1.0, None, 0.0, 0.0]), (4, [math.nan, 1.0, 0.0, 0.0]), (5, [math.inf, 0.0, 0.0, 0.0]), (6, []),
            (7, [1.0, 0.0, 0.0, 0.0]), (8, [2.0, 0.0, 0.0, 0.0]), (8, [2.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.1, 0.0, 0.0]), (None, [0.0, 1.0, 0.0, 0.0]), (None, None),
            (9, [1.0, 0.0]), (10, [3.0, 0.0]), (11, [1.0]), (12, [-1.0]), (13, [5.0]), (14, [3e38, 3e38, 0.0, 0.0]), (15, [1e-40, 1e-40, 0.0, 0.0]), (-5, [0.0, -0.0, 0.0, 1.0])]
    assert got(multi_index.near_duplicates(frame(spark, rows))) == slow(rows)


def test_empty(spark):
    assert multi_index.near_duplicates(frame(spark, [])).collect() == []
    assert got(multi_index.near_duplicates(frame(spark, [(4, None), (4, [0.0])]))) == [(4, 0, 4, True)] * 2
