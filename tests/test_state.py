"""The streaming fold and the expiring cache against their batch forms."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline import schema as S
from weftline.operators import editlog
from weftline.plans import registry
from weftline.streaming import state


def log_of(r, session, n):
    ids = [f"n{i}" for i in range(5)]
    out = []
    for k in range(n):
        op = r.choice(["rename_node", "delete_node", "add_node", "add_edge", "relabel_edge", "retype_edge", "reverse_edge", "delete_edge", "revert"])
        target = r.choice(ids) if op.endswith("node") else f"e-{session}{r.randrange(n):03d}" if op == "revert" else f"r{r.randrange(6)}"
        payload = {"label": f"L{r.randrange(6)}", "glyph": r.choice(S.GLYPHS), "from": r.choice(ids), "to": r.choice(ids)}
        out.append((session, f"e-{session}{k:03d}", op, target, payload, k))
    return out


@pytest.mark.parametrize("order", ["by sequence", "any"])
def test_streamed_fold_equals_the_batch_fold(spark, tmp_path, order):
    r = random.Random(3)
    sessions = [f"s{i}" for i in range(4)]
    nodes = spark.createDataFrame([(s, f"n{i}", f"N{i}", "c", None) for s in sessions for i in range(5)], "session string, id string, label string, community_id string, origin string")
    edges = spark.createDataFrame([(s, f"r{i}", "", f"n{i % 5}", f"n{(i + 1) % 5}", "wave", None) for s in sessions for i in range(6)], "session string, id string, label string, `from` string, `to` string, glyph string, origin string")
    log = [x for s in sessions for x in log_of(r, s, 24)]
    edits = spark.createDataFrame(log, "session string, edit_id string, op string, target string, payload map<string,string>, seq long")
    rows = state.fold_input(nodes, edges, edits)
    # Files in the order of arrival: base first and edits by sequence, or anything in any order.
    parts = 5
    place = F.when(F.col("kind") == "edit", 1 + F.col("seq") * (parts - 1) / 24).otherwise(0).cast("int") if order == "by sequence" else F.pmod(F.xxhash64("session", "id"), F.lit(parts))
    keyed = rows.withColumn("_p", place)
    for p in range(parts):
        keyed.where(f"_p = {p}").drop("_p").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = state.run_all(spark, state.folded(stream), f"fold_{order[:2]}", "update", str(tmp_path / "cp"))
    got = sorted(map(str, state.current(changes).collect()))
    want = sorted(map(str, editlog.fold(nodes, edges, edits).collect()))
    assert got == want and changes.select("version").distinct().count() > 1


def test_streamed_fold_of_the_tables(spark):
    rows = lambda name: sorted(map(str, registry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    assert rows("streamed_fold") == rows("folded_graph")


def test_expiring_cache_equals_pruning(spark, tmp_path):
    r = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"o{r.randrange(4)}", f"k{i}", t0 + dt.timedelta(minutes=r.randrange(3000))) for i in range(120)]
    df = spark.createDataFrame(rows, "owner string, id string, created timestamp")
    for p in range(4):
        df.where(F.pmod(F.xxhash64("id"), F.lit(4)) == p).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = state.run_all(spark, state.expiring(stream, 600), "cache_changes", "append", str(tmp_path / "cp"))
    newest = max(x[2] for x in rows)
    assert {(x.owner, x.id, x.created) for x in state.live(changes).collect()} == {x for x in rows if x[2] > newest - dt.timedelta(minutes=600)}
    assert changes.where("not live").count() > 0
