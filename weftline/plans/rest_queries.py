"""Roots, pins, frozen communities, aggregates opened, indicators, periods and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import routing
from ..operators import editlog, evaluate, graph, levels
from ..session import table
from ..sources import files
from . import demo, graph_queries, log_queries
from .registry import query


@query(demo.duckdb("""SELECT nw.session, nw.id FROM nw LEFT JOIN (SELECT DISTINCT session, "to" AS id FROM sp) t ON t.session = nw.session AND t.id = nw.id WHERE t.id IS NULL"""))
def tree_roots(spark, sf_dir):
    """GR14: nodes without an incoming edge."""
    return graph.tree_roots(demo.nodes(spark, sf_dir, True), demo.ends(spark, sf_dir, True))


@query(demo.duckdb("SELECT hid.session, agg_id AS aggregate, hid.id FROM hid JOIN agg ON agg.session = hid.session AND agg.community = hid.community", graph_queries._VISIBLE))
def expanded_aggregates(spark, sf_dir):
    """GR13: the members of every aggregate."""
    r, v = graph_queries._visible(spark, sf_dir)
    a = levels.build_aggregates(graph_queries._spanless(demo.nodes(spark, sf_dir, True)), r, v)
    return levels.expand(a).select("session", "aggregate", "id")


_PINS = """, eff AS (SELECT * FROM d WHERE op <> 'revert' AND NOT EXISTS (SELECT 1 FROM d r WHERE r.op = 'revert' AND r.session = d.session AND r.target = d.edit_id)), ed AS (SELECT session, CAST(substr(target, 2) AS INTEGER) AS k FROM eff WHERE op IN ('retype_edge', 'delete_edge'))"""


@query(demo.duckdb("""SELECT session, target AS id FROM eff WHERE op IN ('rename_node', 'delete_node') UNION SELECT session, 'un-' || substr(edit_id, 3) FROM eff WHERE op = 'add_node'
    UNION SELECT session, 'x' || k FROM ed UNION SELECT session, 'x' || (k + 1) % 17 FROM ed""", demo.EDITS + _PINS))  # fmt: skip
def pinned_nodes(spark, sf_dir):
    """Nodes that effective edits touch, with both ends of edited edges."""
    _, e, d = log_queries._session_logs(spark, sf_dir)
    return editlog.pins(d, e)


_FROZEN = {"AUTOMOBILE": "k0", "BUILDING": "k1", "FURNITURE": "k0", "HOUSEHOLD": "k1", "MACHINERY": "k2"}
_MAP = " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in _FROZEN.items())


@query(demo.duckdb(f"""SELECT n.session, n.id, coalesce(CASE n.id {_MAP} END, best, n.community_id) AS community FROM n LEFT JOIN (
    SELECT session, id, arg_min(c, printf('%03d', 100 - votes) || c) AS best FROM (SELECT session, "to" AS id, CASE "from" {_MAP} END AS c, count(DISTINCT "from") AS votes FROM g GROUP BY 1, 2, 3) v GROUP BY 1, 2) b
    ON b.session = n.session AND b.id = n.id"""))  # fmt: skip
def frozen_communities(spark, sf_dir):
    """A frozen map of communities, new nodes by the majority of their neighbours."""
    n = demo.nodes(spark, sf_dir)
    community = F.coalesce(*(F.when(F.col("id") == a, k) for a, k in _FROZEN.items()))
    return levels.frozen_communities(n, demo.edges(spark, sf_dir), n.select("session", "id", community.alias("community")).where("community is not null"))


@query(demo.duckdb("""SELECT error_rate, share_4_plus, per_map, evidence_rate, candidates, kept, demoted FROM
    (SELECT round(count_if(event_id % 3 = 1) / count_if(event_id % 3 < 2), 3) AS error_rate, round(count_if(event_id % 2 = 0) / count(*), 3) AS per_map FROM events) a,
    (SELECT round(count_if(s >= 4) / count(s), 3) AS share_4_plus FROM (SELECT CASE WHEN event_id % 6 <> 0 THEN event_id % 5 + 1 END AS s FROM events) x) b,
    (SELECT round(count_if(quantity > 20) / count(*), 3) AS evidence_rate, count_if(glyph = 'arrow' OR quantity > 45) AS candidates, count_if(glyph = 'arrow') AS kept, count_if(glyph <> 'arrow' AND quantity > 45) AS demoted FROM g) c"""))
def kpi_snapshot(spark, sf_dir):
    """All indicators in one row."""
    spans = F.when(F.col("quantity") > 20, F.array(F.struct(F.lit("d").alias("document_id"), F.lit(0).alias("char_start"), F.lit(1).alias("char_end"), F.lit("s").alias("surface"))))
    check = F.when((F.col("glyph") != "arrow") & (F.col("quantity") > 45), F.struct(F.lit("arrow").alias("demoted_from"), F.lit(None).cast("string").alias("verifier_verdict")))
    e = demo.edges(spark, sf_dir).withColumns({"evidence_span": F.coalesce(spans, F.array().cast("array<struct<document_id:string,char_start:int,char_end:int,surface:string>>")), "causal_check": check, "origin": F.lit(None).cast("string")})
    return evaluate.summarize(log_queries._sessions(spark, sf_dir), e)


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts - to_days(CAST(event_id % 40 AS INTEGER)) WHEN 1 THEN date_trunc('week', ts) - INTERVAL 7 DAY WHEN 2 THEN date_trunc('month', ts) WHEN 3 THEN date_trunc('week', ts) ELSE ts - INTERVAL 7 DAY END AS start FROM events""")
def message_periods(spark, sf_dir):
    """from when on a message asks for data."""
    k, ts = F.col("event_id") % 5, F.col("ts").cast("timestamp_ntz")
    said = F.when(k == 0, F.concat(F.lit("直近 "), (F.col("event_id") % 40).cast("string"), F.lit(" 日の変更"))).when(k == 1, "先週の関係").when(k == 2, "今月の件数").when(k == 3, "今週").otherwise("最近の関係")
    e = table(spark, sf_dir, "events").select("event_id", routing.window_start(said, ts.cast("timestamp")).alias("start"))
    return e.select("event_id", F.col("start").cast("timestamp_ntz").alias("start"))


@query("""SELECT event_id, event_type AS kind, user_id % 7 = 0 AS flagged FROM events WHERE event_id % 10 <> 3""")
def logged_events(spark, sf_dir):
    """A log of JSON lines written and read again, without its blank, comment and broken lines."""
    path = f"{files.shared_dir(spark).rstrip('/')}/logs/{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("user_id") % 7 == 0).alias("flagged"))
    bad = F.when(F.col("event_id") % 3 == 0, "// said").when(F.col("event_id") % 3 == 1, "  ").otherwise('{"event_id": 1, "kind')
    e.select(F.when(F.col("event_id") % 10 == 3, bad).otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(path)
    return files.read_log(spark, path, "event_id bigint, kind string, flagged boolean").drop("seq")
