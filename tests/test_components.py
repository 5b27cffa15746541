"""Connected components: one task for few edges, rounds for many, both against a plain search."""

import random

import numpy as np
import pytest

from tabloom.operators.components import connected_components, smallest_reachable


def plain(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = {}
    for node in sorted(near):
        if node not in out:
            todo = [node]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = node
                    todo += near[x]
    return out


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(5, 1), (1, 5), (5, 1)], [(i, i + 1) for i in range(2000)], [(0, i) for i in range(1, 500)] + [(-7, 900)]])
def test_small_shapes(edges):
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    nodes, least = smallest_reachable(u, v)
    assert dict(zip(nodes.tolist(), least.tolist())) == plain(edges)


@pytest.mark.parametrize("limit", [0, 10, 10_000])
def test_one_task_equals_rounds(spark, limit):
    r = random.Random(4)
    edges = [(r.randrange(600), r.randrange(600)) for _ in range(330)]
    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), single_task_rows=limit).collect()
    assert {x.node: x.component for x in got} == plain(edges) and len(got) == len(plain(edges))
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint"), single_task_rows=limit).count() == 0


def test_nodes_of_text(spark):
    edges = [("b.org/x", "a.org"), ("c.net", "b.org/x"), ("z", "y"), ("é", "z")]
    got = connected_components(spark.createDataFrame(edges, "u string, v string")).collect()
    assert {x.node: x.component for x in got} == plain(edges)
