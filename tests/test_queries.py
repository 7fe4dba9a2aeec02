"""Every query of the graph engine against its SQL, or at least its schema and rows."""

from __future__ import annotations

import pytest
from oracle import differences

from weftline.operators import community, graph, levels
from weftline.plans import demo, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert not differences(df, sql, SF)
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["quota_top_k", "level_edges", "corpus_edge_merge", "stratified_queue"])
def test_partitioning_does_not_matter(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, registry.queries()[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]


def test_queries_without_sql_take_all_rows(spark):
    n, e = demo.nodes(spark, SF), demo.edges(spark, SF)
    q = {k: registry.queries()[k](spark, SF) for k in ("session_betweenness", "session_communities", "node_importance", "level_selection", "corpus_communities")}
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(q["session_betweenness"]) == rows(graph.betweenness(n, e))
    assert rows(q["session_communities"]) == rows(community.communities(n, e))
    bare = n.selectExpr("*", "CAST(null AS double) AS mentions", "CAST(null AS double) AS novelty")
    assert rows(q["node_importance"]) == rows(levels.importance(bare, e))
    d = graph.degree(n, e).join(n, ["session", "id"])
    ranked = d.select("session", "id", d.community_id.alias("community"), levels.min_max(d.incident.cast("double"), ["session"]).alias("total")).selectExpr("*", "false AS pinned")
    assert rows(q["level_selection"]) == rows(levels.select_nodes(ranked))
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    want = {f"s{r[0]}" for r in li.select("l_suppkey").distinct().collect()} | {f"p{r[0]}" for r in li.select("l_partkey").distinct().collect()}
    assert {r.label_norm for r in q["corpus_communities"].collect()} == want
