"""Paths from both ends against a search of all walks."""

import math
import random

import pytest

from tesserine.operators import graph


def brute(edges, start, goal, depth, hops):
    best, walks = None, [(0.0, (start,))]
    for _ in range(depth + 1):
        for c, w in walks:
            if w[-1] == goal and (best is None or (round(c, 9), w) < (round(best[0], 9), best[1])):
                best = (c, w)
        walks = [(c + (1.0 if hops else -math.log(s)), (*w, t)) for c, w in walks if w[-1] != goal for f, t, s in edges if f == w[-1] and t not in w]
    return best


@pytest.mark.parametrize("hops", [False, True])
def test_random_graphs(spark, hops):
    rng = random.Random(3)
    for _ in range(3):
        edges = [(str(a), str(b), rng.choice([0.25, 0.5, 0.5, 0.9, 1.0])) for a in range(9) for b in range(9) if a != b and rng.random() < 0.25]
        frame = spark.createDataFrame(edges, "from_id string, to_id string, strength double").cache()
        for goal, depth in (("8", 3), ("7", 6)):
            run = graph.shortest_path_hops if hops else graph.shortest_path
            got, expected = run(frame, "0", goal, graph.Traversal(max_depth=depth)).first(), brute(edges, "0", goal, depth, hops)
            assert (got is None) == (expected is None)
            if got:
                assert got.cost == pytest.approx(expected[0])
                # equal sums of other orders may differ in their last digits; hops are exact
                assert tuple(got.path) == expected[1] if hops else len(got.path) > 1


def test_search_ends_where_no_path_can_be_cheaper(spark, monkeypatch):
    chain = [(str(i), str(i + 1), 0.9) for i in range(12)] + [(str(i), f"x{i}-{k}", 0.01) for i in range(12) for k in range(20)] + [(f"x{i}-{k}", f"y{i}-{k}", 0.5) for i in range(12) for k in range(20)]
    frame = spark.createDataFrame(chain, "from_id string, to_id string, strength double").cache()
    seen = []
    own = graph._paths
    monkeypatch.setattr(graph, "_paths", lambda ways, *rest: (seen.append(ways.count()), own(ways, *rest))[1])
    found = graph.shortest_path(frame, "0", "12", graph.Traversal(max_depth=20)).first()
    assert found.path == [str(i) for i in range(13)] and found.cost == pytest.approx(-12 * math.log(0.9))
    assert seen == [12]  # no side way is within the bound
