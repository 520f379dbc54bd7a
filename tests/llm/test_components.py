import random

import pytest

from tidewell import skew
from tidewell.llm import components as module
from tidewell.llm.components import components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    return {x: find(x) for x in parent if x not in loops}


def solved(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r["node"] for r in got}) == len(got)
    return {r["node"]: r["root"] for r in got}


@pytest.mark.parametrize("bound", [0, 1 << 24])
def test_random_graphs_with_a_hub(spark, monkeypatch, bound):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", bound)
    r = random.Random(bound)
    nodes = [r.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(300)] + [(nodes[0], x) for x in nodes[:150]] + [(7, 7), (5, 6), (6, 5)]
    assert solved(spark, edges) == brute(edges)


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_chain_of_a_thousand_edges_takes_few_rounds(spark, monkeypatch, shuffled):
    names = list(range(1001))
    if shuffled:
        random.Random(1).shuffle(names)
    stored = []
    monkeypatch.setattr(module, "_roots", lambda pointers, label, f=module._roots: stored.append(1) or f(pointers, label))
    edges = [(names[k], names[k + 1]) for k in range(1000)]
    assert set(solved(spark, edges).values()) == {0}
    assert len(stored) <= (8 if shuffled else 2)


def test_jumps_double(spark, monkeypatch):
    writes = []
    monkeypatch.setattr(module, "materialize", lambda df, label, f=module.materialize: writes.append(1) or f(df, label))
    assert set(solved(spark, [(k, k + 1) for k in range(1000)]).values()) == {0}
    assert len(writes) <= 15


def test_no_edges(spark):
    assert solved(spark, []) == {} and solved(spark, [(3, 3)]) == {}
