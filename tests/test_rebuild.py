"""Edits appended with their checks, and the rebuilt view."""

from __future__ import annotations

import datetime as dt

import pytest
from test_operators import edges, nodes

from weftline import schema as S
from weftline.operators import gaps, rebuild
from weftline.sources import files

LOG = "session string, edit_id string, op string, target string, payload map<string,string>, seq long"


def test_append_edit(spark, tmp_path):
    n, e = nodes(spark, [("a", "x"), ("b", "x")]), edges(spark, [("1", "a", "b", "wave", 1.0)])
    log = spark.createDataFrame([("s", "e-20240101-004", "relabel_edge", "1", {"label": "L"}, 0)], LOG)
    at, now = str(tmp_path / "log"), dt.datetime(2024, 1, 1, 9)
    row = rebuild.append_edit(n, e, log, at, "s", "delete_edge", "1", now=now)
    assert row["edit_id"] == "e-20240101-005" and row["before"]["label"] == "L" and row["before"]["from_label"] == "a"
    got = files.read_log(spark, at, S.EDIT).collect()
    assert [(r.edit_id, r.op, r.target) for r in got] == [("e-20240101-005", "delete_edge", "1")]
    for bad in (("rename_node", "a", {"label": " B "}), ("rename_node", "q", {"label": "z"}), ("add_edge", None, {"from": "a", "to": "a"}), ("add_edge", None, {"from": "a", "to": "b"}), ("revert", "e-1", None), ("retype_edge", "1", {"glyph": "no"})):
        with pytest.raises(rebuild.EditError):
            rebuild.append_edit(n, e, log, at, "s", *bad, now=now)
    assert rebuild.append_edit(n, e, log, at, "s", "revert", "e-20240101-004", now=now)["op"] == "revert"


def test_rebuild_keeps_decisions_and_pins(spark):
    n, e = nodes(spark, [(f"c{i:02d}", f"k{i % 2}") for i in range(30)]), edges(spark, [(f"r{i}", f"c{i:02d}", f"c{i + 2:02d}", "wave", 0.5) for i in range(26)])
    c = spark.createDataFrame([("s", "k0", "K0", False), ("s", "k1", "K1", False)], S.COMMUNITY)
    log = spark.createDataFrame([("s", "e-1", "rename_node", "c29", {"label": "new"}, 0), ("s", "e-2", "delete_node", "zz", {}, 1)], LOG)
    old = gaps.detect(n, e, c).where("gap_id = 'gap-isolated-c29'").selectExpr("* except (status)", "'confirmed' as status")
    out = rebuild.rebuild(n, e, c, log, e.limit(0), old)
    assert out["nodes"].where("label = 'new'").count() == 1 and out["warnings"].count() == 1
    assert {r.gap_id for r in out["gaps"].where("status = 'confirmed'").collect()} == {"gap-isolated-c29"}
    assert out["visible"].where("level = 'overview' and id = 'c29'").count() == 1
