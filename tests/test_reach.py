"""Sampled betweenness and strong components against plain algorithms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, reach


def on_cycle(edges) -> dict:
    """{id: greatest id of its strong component} of ids that reach themselves."""
    down: dict = {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)

    def reached(v):
        seen, todo = set(), list(down.get(v, ()))
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += down.get(w, ())
        return seen

    to = {v: reached(v) for v in {x for e in edges for x in e}}
    return {v: max(w for w in to[v] if v in to[w]) for v in to if v in to[v]}


def test_strong_components_against_reachability(spark):
    r = random.Random(6)
    graphs = {f"s{i}": [(r.randrange(14), r.randrange(14)) for _ in range(r.choice([6, 14, 18, 24]))] for i in range(30)}
    graphs["ring"] = [(i, (i + 1) % 40) for i in range(40)]
    graphs["chain"] = [(i, i + 1) for i in range(16)]
    graphs["down"] = [(i + 1, i) for i in range(16)]
    # A chain of rings, all with a way from each to the next.
    graphs["rings"] = [(5 * k + i, 5 * k + (i + 1) % 5) for k in range(6) for i in range(5)] + [(5 * k, 5 * k + 7) for k in range(5)]
    rows = [(s, a, b) for s, e in graphs.items() for a, b in e] + [("null", None, 1), ("null", 1, None)]
    df = spark.createDataFrame(rows, "session string, a long, b long")
    got = {(r.session, r.id): r.component for r in reach.strong_components(df).collect()}
    assert got == {(s, v): c for s, e in graphs.items() for v, c in on_cycle(e).items()}
    members = graph.cycle_members(df.select("session", F.col("a").alias("child"), F.col("b").alias("parent")))
    assert {tuple(r) for r in members.collect()} == set(got)
    assert "applyInPandas" not in members._jdf.queryExecution().toString() and not reach.strong_components(df.where("false")).collect()


def random_graph(n, degree, seed):
    r = random.Random(seed)
    return [f"n{i:03d}" for i in range(n)], sorted({tuple(sorted(r.sample([f"n{i:03d}" for i in range(n)], 2))) for _ in range(n * degree // 2)})


def test_all_pivots_give_the_exact_result(spark):
    graphs = {"a": random_graph(30, 3, 1), "b": random_graph(24, 2, 2), "two": (["x", "y"], [("x", "y")]), "one": (["x"], []), "chain": ([f"c{i}" for i in range(9)], [(f"c{i}", f"c{i + 1}") for i in range(8)])}
    ids = spark.createDataFrame([(s, i) for s, (v, _) in graphs.items() for i in v], "session string, id string")
    pairs = spark.createDataFrame([(s, *p) for s, (_, e) in graphs.items() for p in [*e, *[(b, a) for a, b in e[:3]], *[(a, a) for a, _ in e[:1]]]], "session string, a string, b string")
    got = {(r.session, r.id): r.betweenness for r in reach.pivot_betweenness(ids, pairs).collect()}
    want = {(s, i): x for s, (v, e) in graphs.items() for i, x in graph.brandes(v, e).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("most,error", [(25, 0.6), (100, 0.25), (200, 1e-9)])
def test_error_of_a_sample(spark, most, error):
    v, e = random_graph(200, 4, 3)
    ids = spark.createDataFrame([("s", i) for i in v], "session string, id string")
    got = {r.id: r.betweenness for r in reach.pivot_betweenness(ids, spark.createDataFrame([("s", *p) for p in e], "session string, a string, b string"), most).collect()}
    want = graph.brandes(v, e)
    top = sorted(want, key=want.get)[-20:]
    assert sum(abs(got[i] - want[i]) for i in top) / sum(want[i] for i in top) <= error
    assert most < 100 or len(set(top) & set(sorted(got, key=got.get)[-20:])) >= 14
