"""One test for each finding of the fourth review; each failed before its change."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
from pyspark.sql import functions as F
from test_community import connected, quality

from weftline.operators import checks, community
from weftline.plans import demo, registry
from weftline.sources import trigram
from weftline.streaming import state

SF = "/root/testdata/sf0.001"


def test_f6_all_nodes_within_two_hops_are_there(spark, monkeypatch):
    seed, many = "Supplier#000000001", 100_010
    near = spark.range(many).selectExpr("'s' as session", "cast(id as string) as id")
    monkeypatch.setattr(demo, "nodes", lambda *_: near.unionByName(spark.createDataFrame([("s", seed)], near.schema)))
    monkeypatch.setattr(demo, "ends", lambda *_: near.selectExpr("session", f"'{seed}' as `from`", "id as `to`"))
    got = registry.queries()["two_hop_neighborhood"](spark, SF)
    assert {r.hop: r["count"] for r in got.groupBy("hop").count().collect()} == {0: 1, 1: many}  # before, 100,000 nodes of a session at most


def test_f1_f2_rounds_over_arrays_end_where_nothing_gains(monkeypatch):
    r = random.Random(8)
    for chunk, gamma in itertools.product((7, 1 << 20), (0.4, 1.0)):
        monkeypatch.setattr(community, "CHUNK", chunk)
        ids = list(range(r.randint(2, 60)))
        edges = [(0, 1, 1.0)] + [(a, b, r.choice([0.5, 1.0, 2.0])) for a, b in itertools.combinations(ids, 2) if b > 1 and r.random() < (0.3 if a % 4 == b % 4 else 0.03)]
        a, b, w = (np.array(x) for x in zip(*sorted(edges + [(b, a, w) for a, b, w in edges])))
        got = community._in_rounds(community._Arrays(a, b, w, np.bincount(a, w, len(ids))), gamma)
        part, q = dict(enumerate(got.tolist())), quality(edges, dict(enumerate(got.tolist())), gamma)
        assert connected(edges, {x: part[x] for e in edges for x in e[:2]})
        for x, c in itertools.product(ids, set(part.values())):
            assert quality(edges, part | {x: c}, gamma) <= q + 1e-9
        for c, d in itertools.combinations(set(part.values()), 2):
            assert quality(edges, {x: c if p == d else p for x, p in part.items()}, gamma) <= q + 1e-9
        leiden = community.leiden([f"{i:02d}" for i in ids], [(f"{a:02d}", f"{b:02d}", w) for a, b, w in edges], gamma)
        assert q >= 0.9 * quality(edges, {int(x): c for x, c in leiden.items()}, gamma)


def test_f1_f2_a_graph_of_many_edges_is_finished_without_rounds_of_tables(spark, monkeypatch):
    df = spark.range(120_000).select(F.concat(F.lit("a"), F.pmod(F.xxhash64("id"), F.lit(2_000))).alias("a"), F.concat(F.lit("b"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2_000))).alias("b"), F.lit(1.0).alias("weight"))
    monkeypatch.setattr(community, "_merge_round", None)  # before, from 100,000 edges on
    monkeypatch.setattr(community, "_move_round", None)
    got = community.corpus_levels(df)
    assert got.count() == 4_000 and got.where("community > id").isEmpty() and got.first().modularity > 0.1


def test_f3_pairs_are_made_where_blocks_meet(spark):
    got = checks.overlaps(spark.range(50).selectExpr("'s' as session", "id", "cast(id * 9 % 40 as double) as x", "cast(id % 30 as double) as y", "20d as w", "10d as h"))
    steps = got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert got.count() > 300 and "Repartition" not in steps  # before, pairs of blocks were moved with their ids


def test_f4_owners_share_shards_and_entries_expire_to_the_microsecond(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0, 1_500)
    files = [[(f"o{i}", f"k{i}", t0) for i in range(40)], [("o1", "k1", t0 + dt.timedelta(minutes=5))], [("o2", "new", t0 + dt.timedelta(minutes=12))], [(None, "last", t0 + dt.timedelta(minutes=13)), ("o3", "k3", None)]]
    for rows in files:
        spark.createDataFrame(rows, "owner string, id string, created timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("owner string, id string, created timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    frame = state.expiring(stream, 10, 3)
    assert "pmod(xxhash64(owner" in frame._jdf.queryExecution().analyzed().toString()  # before, a group for each owner
    changes = state.run_all(spark, frame, "f4_cache", "append", str(tmp_path / "cp"))
    assert {(x.owner, x.id, x.created) for x in state.live(changes).collect()} == {x for rows in files[1:] for x in rows if x[2]}
    assert changes.where("not live").count() == 40


def test_f5_postings_grow_with_the_texts_and_not_with_their_pairs(spark, tmp_path):
    labels, ends = ["large ring", "small ring", "", None, "ab", "RING of 50%"], [f"Supplier {i:03d}" for i in range(40)] + ["the ring", None, "b"]
    rows = [(f"e{i}", *x) for i, x in enumerate(itertools.product(labels, ends))]
    e = spark.createDataFrame(rows, "edge_id string, label string, evidence string")
    trigram.build_search(spark.createDataFrame([("x",)], "label_norm string"), e, str(tmp_path))
    text = F.concat_ws("\n", F.lower("label"), F.lower("evidence"))
    for q in ("ring", "supplier 01", "large ring", "ing\nsup", "b", "", "50%", "ng of", "nothing", "the ring"):
        got = trigram.find_pair(spark, f"{tmp_path}/edges", *trigram._edge(), q)
        assert sorted(map(str, got.collect())) == sorted(map(str, e.where(text.contains(q)).collect())), q
    posts = [spark.read.parquet(f"{tmp_path}/edges/{x}/posts").where("gram = 'rin'").count() for x in ("first", "second")]
    assert posts == [3, 1]  # before, one for each pair with a ring
