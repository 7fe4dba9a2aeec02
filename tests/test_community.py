"""Leiden and the distributed contraction against brute force and SQL."""

from __future__ import annotations

import itertools
import random

import duckdb
import pytest
from oracle import TABLES
from pyspark.sql import functions as F

from weftline.operators import community, graph
from weftline.plans import demo, registry
from weftline.sources.files import Steps

SF = "/root/testdata/sf0.001"


def quality(edges, part, resolution=1.0):
    m = sum(w for *_, w in edges)
    k = {}
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = sum(w for a, b, w in edges if part[a] == part[b]) / m
    return inside - resolution * sum((sum(v for x, v in k.items() if part[x] == c) / (2 * m)) ** 2 for c in set(part.values()))


def partitions(xs):
    if not xs:
        yield {}
        return
    for p in partitions(xs[1:]):
        for c in {*p.values(), xs[0]}:
            yield p | {xs[0]: c}


def connected(edges, part):
    for c in set(part.values()):
        members = {x for x in part if part[x] == c}
        seen, todo = set(), [min(members)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [b if a == v else a for a, b, _ in edges if v in (a, b) and {a, b} <= members]
        if seen != members:
            return False
    return True


def plain_louvain(ids, edges, resolution):
    """Moves of single nodes and contraction of whole communities, without refinement."""
    net = community._Network([{} for _ in ids], [0.0] * len(ids))
    at = {x: i for i, x in enumerate(sorted(ids))}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            net.links[at[x]][at[y]] = net.links[at[x]].get(at[y], 0.0) + w
    net = community._Network(net.links, net.inner)
    part, g = list(range(len(ids))), net
    while True:
        step = community._moved(g, list(range(len(g.links))), resolution)
        if max(step) + 1 == len(step):
            return {x: part[i] for x, i in at.items()}
        part, g = [step[p] for p in part], g.contracted(step)


def test_leiden_against_all_partitions_of_small_graphs():
    r, short, best_all = random.Random(4), 0, 0
    for _ in range(120):
        ids = "abcdefg"[: r.randint(2, 7)]
        edges = [(a, b, r.choice([0.5, 1.0, 2.0])) for a, b in itertools.combinations(ids, 2) if r.random() < 0.5]
        for gamma in (0.4, 1.0):
            got = community.leiden(list(ids), edges, gamma)
            assert sorted(got) == sorted(ids)
            if edges:
                assert connected(edges, got)
                q, best = quality(edges, got, gamma), max(quality(edges, p, gamma) for p in partitions(list(ids)))
                assert q <= best + 1e-9
                short, best_all = short + (q < best - 1e-9), best_all + 1
                assert q >= quality(edges, plain_louvain(ids, edges, gamma), gamma) - 1e-9
    assert short <= best_all * 0.05


def test_leiden_of_larger_graphs_is_connected_and_not_below_plain_contraction():
    r, better = random.Random(9), 0
    for n, inner in ((60, 0.3), (150, 0.12), (300, 0.05)):
        for _ in range(3):
            ids = [f"n{i:03d}" for i in range(n)]
            edges = [(a, b, 1.0) for a, b in itertools.combinations(ids, 2) if r.random() < (inner if int(a[1:]) % 6 == int(b[1:]) % 6 else 0.02)]
            got = community.leiden(ids, edges)
            a, b = quality(edges, got), quality(edges, plain_louvain(ids, edges, 1.0))
            assert connected(edges, got) and a >= b - 1e-9
            better += a > b + 1e-9
    assert better >= 3
    # A ring of cliques, and two far nodes that only their hub holds together.
    ring = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcdefgh" for i, j in itertools.combinations(range(5), 2)] + [(f"{c}0", f"{d}1", 1.0) for c, d in zip("abcdefgh", "bcdefgha")]
    got = community.leiden(sorted({x for e in ring for x in e[:2]}), ring)
    assert len(set(got.values())) == 8 and all(len({got[f"{c}{i}"] for i in range(5)}) == 1 for c in "abcdefgh")


def test_leiden_on_all_sessions_is_not_below_plain_contraction(spark):
    n, e = demo.nodes(spark, SF, True), demo.edges(spark, SF, True)
    got = {}
    for r in community.communities(n, e).collect():
        got.setdefault(r.session, {})[r.id] = r.community
    pairs = {}
    for r in graph.undirected(n, e).collect():
        pairs.setdefault(r.session, []).append((r.a, r.b, r.weight))
    for s, part in got.items():
        mine = quality(pairs[s], part)
        assert connected(pairs[s], part) and mine >= quality(pairs[s], plain_louvain(list(part), pairs[s], 1.0)) - 1e-9
    assert set(got) == {r.session for r in n.select("session").distinct().collect()}


def steps_of(spark, edges, resolution=1.0, local_edges=0):
    df = spark.createDataFrame(edges, "a string, b string, weight double").repartition(3)
    out = {}
    for r in community.corpus_levels(df, resolution, local_edges).collect():
        step = out.setdefault(r.step, ({}, r.modularity))
        step[0][r.id] = r.community
    return [out[i] for i in range(len(out))]


@pytest.mark.parametrize("resolution,local_edges", [(1.0, 0), (0.4, 40), (1.0, 10**6)])
def test_contraction_grows_to_a_partition_that_no_merge_and_no_move_betters(spark, resolution, local_edges):
    r = random.Random(2)
    ids = [f"n{i:02d}" for i in range(40)]
    edges = [(a, b, r.choice([1.0, 2.0])) for a, b in itertools.combinations(ids, 2) if r.random() < (0.3 if int(a[1:]) % 4 == int(b[1:]) % 4 else 0.03)]
    steps = steps_of(spark, edges, resolution, local_edges)
    qs = [q for _, q in steps]
    for part, q in steps:
        assert abs(quality(edges, part, resolution) - q) < 1e-9 and connected(edges, part) and all(c == min(x for x in part if part[x] == c) for c in part.values())
    assert all(a < b + 1e-12 for a, b in zip(qs, qs[1:]))
    part, q = steps[-1]
    for a, b in itertools.combinations(sorted(set(part.values())), 2):
        assert quality(edges, {x: a if c == b else c for x, c in part.items()}, resolution) <= q + 1e-9
    for x in part:
        for c in set(part.values()):
            assert quality(edges, part | {x: c}, resolution) <= q + 1e-9
    leiden = community.leiden(ids, edges, resolution)
    assert q > 0.9 * quality(edges, leiden, resolution)


def test_contraction_of_a_star_a_chain_and_nothing(spark):
    star = [("hub", f"x{i:03d}", 1.0) for i in range(30)]
    assert len(set(steps_of(spark, star)[-1][0].values())) == 1
    chain = [(f"c{i:03d}", f"c{i + 1:03d}", 1.0) for i in range(24)]
    part, q = steps_of(spark, chain)[-1]
    assert q > 0.5 and connected(chain, part)
    assert not community.corpus_levels(spark.createDataFrame([], "a string, b string, weight double")).collect()
    loops = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 2.0), ("b", "a", 1.0)], "a string, b string, weight double")
    assert {(r.id, r.community, r.modularity) for r in community.corpus_levels(loops).collect()} == {("a", "a", 0.0), ("b", "a", 0.0)}


def test_modularity_of_the_corpus_by_sql(spark):
    """The modularity in the results against DuckDB over the same partition and the line items."""
    rows = registry.queries()["corpus_communities"](spark, SF).collect()
    steps = registry.queries()["corpus_community_steps"](spark, SF).orderBy("level", "step").collect()
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = [(r.level, r.label_norm, r.community) for r in rows]  # noqa: F841
    import pandas as pd

    c.register("found", pd.DataFrame(found, columns=["level", "id", "community"]))
    sql = """WITH p AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
        e AS (SELECT x.level, x.community AS ca, y.community AS cb, w FROM p JOIN found x ON x.id = a JOIN found y ON y.id = b AND y.level = x.level),
        k AS (SELECT level, c, sum(w) AS k FROM (SELECT level, ca AS c, w FROM e UNION ALL SELECT level, cb, w FROM e) GROUP BY 1, 2),
        m AS (SELECT level, sum(w) AS m, sum(w) FILTER (WHERE ca = cb) AS inside FROM e GROUP BY 1)
        SELECT m.level, inside / m - (CASE m.level WHEN 'coarse' THEN 0.4 ELSE 1.0 END) * sum(k * k) / (4 * m * m) FROM k JOIN m USING (level) GROUP BY m.level, inside, m.m"""
    want = dict(c.execute(sql).fetchall())
    assert len(want) == 2
    for r in rows:
        assert abs(r.modularity - want[r.level]) < 1e-9
    for level, q in want.items():
        mine = [r for r in steps if r.level == level]
        assert abs(mine[-1].modularity - q) < 1e-9 and [r.step for r in mine] == list(range(len(mine))) and all(a.modularity <= b.modularity for a, b in zip(mine, mine[1:]))


def test_components_of_a_long_chain(spark):
    n = 100_000
    df = spark.range(n).selectExpr("concat('n', lpad(cast((id * 7919) % 100003 as string), 6, '0')) as a", "concat('n', lpad(cast(((id + 1) * 7919) % 100003 as string), 6, '0')) as b")
    got = graph.connected_components(df)
    assert got.count() == n + 1 and {r.component for r in got.select("component").distinct().collect()} == {min(r.id for r in got.select("id").collect())}


def test_many_nodes_move_in_one_round(spark):
    """60 leaves of two hubs, all with one hub: half of them gain by moving, and a round moves many, as far as each gains after those before it."""
    links = [(h, f"x{i:02d}", 1.0) for i in range(60) for h in ("hub_a", "hub_b")]
    both = spark.createDataFrame(links + [(b, a, w) for a, b, w in links], "a string, b string, w double")
    strength = both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    label = strength.select("id", F.when(F.col("id") == "hub_b", "hub_b").otherwise("hub_a").alias("community"))
    with Steps(spark) as steps:
        moved = {r.id: r.to for r in community._move_round(both, strength, label, 120.0, 1.0, 0, steps).collect()}
    before = {r.id: r.community for r in label.collect()}
    assert len(moved) >= 20 and set(moved.values()) == {"hub_b"}
    assert quality(links, before | moved, 1.0) > quality(links, before, 1.0)
