"""Appending an edit with its checks, and rebuilding what is shown after it."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.relations import with_projection
from . import editlog, gaps, levels


class EditError(ValueError):
    """An edit that is not allowed; the message says why."""


def session_graph(nodes: DataFrame, edges: DataFrame, edits: DataFrame, session: str) -> editlog.Graph:
    """The current graph of one session (some thousand rows at most) on the driver."""
    rows = editlog.fold(*(df.where(F.col("session") == session) for df in (nodes, edges, edits))).where("kind <> 'warning'").collect()
    n = [{"id": r.id, "label": r.label, "norm": editlog._norm(r.label), "community_id": r.community_id, "origin": r.origin} for r in rows if r.kind == "node"]
    e = [{"id": r.id, "from": r["from"], "to": r["to"], "label": r.label, "glyph": r.glyph, "origin": r.origin} for r in rows if r.kind == "edge"]
    return editlog.Graph(n, e)


def append_edit(nodes: DataFrame, edges: DataFrame, edits: DataFrame, path: str, session: str, op: str, target: str | None = None, payload: dict | None = None, user: str = "user", now: dt.datetime | None = None) -> dict:
    """Checks an edit against the current graph, numbers it, keeps what was before, appends it to the log at ``path``; the row."""
    now, p = now or dt.datetime.now(), payload or {}
    own = edits.where(F.col("session") == session)
    ids = {r.edit_id for r in own.select("edit_id").collect()}
    g = session_graph(nodes, edges, edits, session)
    if op == "revert":
        dead = {r.target for r in own.where("op = 'revert'").select("target").collect()}
        if target not in ids or target in dead:
            raise EditError("nothing to revert")
    elif why := g.refused(op, target, p):
        raise EditError(why)
    day = now.strftime("%Y%m%d")
    last = max((int(i.rsplit("-", 1)[1]) for i in ids if i.startswith(f"e-{day}-")), default=0)
    before = g.nodes.get(target) if op in editlog.NODE_OPS else g.edges.get(target)
    if before and op in editlog.EDGE_OPS:  # learning needs the labels from the log alone
        before = before | {f"{x}_label": g.nodes[before[x]]["label"] for x in ("from", "to") if before[x] in g.nodes}
    row = {"session": session, "edit_id": f"e-{day}-{last + 1:03d}", "ts": now.isoformat(timespec="seconds"), "user": user, "op": op, "target": target, "payload": p, "before": before}
    spark = nodes.sparkSession
    spark.createDataFrame([(json.dumps(row, ensure_ascii=False),)], "value string").coalesce(1).write.mode("append").text(path)
    return row


def rebuild(nodes: DataFrame, edges: DataFrame, communities: DataFrame, edits: DataFrame, plan_edges: DataFrame, old_gaps: DataFrame, frozen: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything shown of all sessions after their edits: current graph, levels with pinned nodes, gaps with earlier decisions."""
    now = editlog.fold(nodes, edges, edits)
    cur = now.where("kind = 'node'").select("session", "id", "label", "community_id", "origin")
    extra = nodes.select("session", "id", "evidence_span", "claim_refs", "mentions", "novelty")
    cur = cur.join(extra, ["session", "id"], "left").withColumn("evidence_span", F.coalesce("evidence_span", F.array().cast(S.SPANS)))
    attrs = edges.select("session", "id", "confidence", "evidence_span", "layer_tags", "causal_check", "causal_override", "validation", "polarity")
    links = now.where("kind = 'edge'").select("session", "id", "from", "to", "label", "glyph", "origin").join(attrs, ["session", "id"], "left")
    links = editlog.reconcile_policy(links, plan_edges).withColumn("evidence_span", F.coalesce("evidence_span", F.array().cast(S.SPANS)))
    links = with_projection(links)
    out = levels.analyze(cur, links, communities, editlog.pins(edits, links), frozen)
    return out | {"nodes": cur, "current_edges": links, "gaps": gaps.carry_decisions(gaps.detect(cur, links, communities), old_gaps), "warnings": now.where("kind = 'warning'").select("session", F.col("label").alias("warning"))}
