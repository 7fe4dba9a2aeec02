"""Event-sourced edits: which are effective, their fold into a graph, what is learned from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import normalize_label

NODE_OPS = ("rename_node", "delete_node")
EDGE_OPS = ("relabel_edge", "retype_edge", "reverse_edge", "delete_edge")
FEW_SHOT = 40


def effective(edits: DataFrame) -> DataFrame:
    """Edits that no revert names; reverts are collected from the whole log and cannot be reverted."""
    dead = edits.where("op = 'revert' and target is not null").select("session", F.col("target").alias("edit_id")).distinct()
    return edits.where("op <> 'revert'").join(dead, ["session", "edit_id"], "left_anti")


def annotate(edits: DataFrame) -> DataFrame:
    """Edits with the id of the last revert that names them."""
    by = edits.where("op = 'revert'").groupBy("session", F.col("target").alias("edit_id")).agg(F.max_by(F.col("edit_id"), "seq").alias("reverted_by"))
    return edits.join(by, ["session", "edit_id"], "left")


def numbered(new: DataFrame, known: DataFrame) -> DataFrame:
    """New edits (session, day, seq) with ids ``e-YYYYMMDD-NNN`` that go on from the largest of their day."""
    last = known.select("session", F.regexp_extract("edit_id", r"^e-(\d{8})-\d+$", 1).alias("day"), F.regexp_extract("edit_id", r"-(\d+)$", 1).cast("int").alias("k")).groupBy("session", "day").agg(F.max("k").alias("k"))
    n = new.join(last, ["session", "day"], "left").withColumn("_r", F.row_number().over(Window.partitionBy("session", "day").orderBy("seq")) + F.coalesce("k", F.lit(0)))
    return n.withColumn("edit_id", F.concat(F.lit("e-"), "day", F.lit("-"), F.lpad(F.col("_r").cast("string"), 3, "0"))).drop("k", "_r")


def pins(edits: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, id): nodes that effective edits touch, with both ends of edited edges."""
    e = effective(edits)
    direct = e.where(F.col("op").isin(*NODE_OPS)).select("session", F.col("target").alias("id"))
    added = e.where("op = 'add_node'").select("session", F.coalesce(F.col("payload")["id"], F.concat(F.lit("un-"), F.regexp_replace("edit_id", "^e-", ""))).alias("id"))
    ends = e.where(F.col("op").isin(*EDGE_OPS)).select("session", F.col("target").alias("eid")).join(edges.select("session", F.col("id").alias("eid"), "from", "to"), ["session", "eid"]).select("session", F.explode(F.array("from", "to")).alias("id"))
    new = e.where("op = 'add_edge'").select("session", F.explode(F.array(F.col("payload")["from"], F.col("payload")["to"])).alias("id"))
    return direct.unionByName(added).unionByName(ends).unionByName(new).where("id is not null").distinct()


class Graph:
    """One session's nodes and edges under edits; an edit that cannot apply is a warning."""

    def __init__(self, nodes: list[dict], edges: list[dict]):
        self.nodes = {n["id"]: dict(n) for n in nodes}
        self.edges = {e["id"]: dict(e) for e in edges}
        self.warnings: list[str] = []

    def refused(self, op: str, target, p: dict) -> str | None:
        """Why an edit is not allowed in the present state; null if it is."""
        if op in NODE_OPS and target not in self.nodes:
            return "no such node"
        if op in EDGE_OPS and target not in self.edges:
            return "no such edge"
        label = (p.get("label") or "").strip()
        if op in ("rename_node", "add_node"):
            if not label:
                return "empty label"
            if any(n["norm"] == _norm(label) for i, n in self.nodes.items() if i != target):
                return "label exists"
        if op == "retype_edge" and p.get("glyph") not in S.GLYPHS:
            return "unknown glyph"
        if op == "add_edge":
            a, b, g = p.get("from"), p.get("to"), p.get("glyph") or "wave"
            if a not in self.nodes or b not in self.nodes:
                return "no such node"
            if a == b:
                return "self loop"
            if g not in S.GLYPHS:
                return "unknown glyph"
            if any((e["from"], e["to"], e["glyph"]) == (a, b, g) for e in self.edges.values()):
                return "edge exists"
        return None if op in S.EDIT_OPS else "unknown operation"

    def apply(self, edit_id: str, op: str, target, p: dict | None) -> None:
        p = p or {}
        if why := self.refused(op, target, p):
            # A fold keeps colliding labels: only what has no target or no meaning is left out.
            if why not in ("label exists", "edge exists") or op == "add_edge" and why == "edge exists" and p.get("id") in self.edges:
                self.warnings.append(f"{edit_id} ({op}): {why}")
                return
        seed = edit_id.removeprefix("e-")
        if op == "rename_node":
            self.nodes[target] |= {"label": p["label"], "norm": _norm(p["label"]), "origin": "user_edited"}
        elif op == "delete_node":
            del self.nodes[target]
            self.edges = {i: e for i, e in self.edges.items() if target not in (e["from"], e["to"])}
        elif op == "add_node":
            i = p.get("id") or self._free(f"un-{seed}", self.nodes)
            if i in self.nodes:
                self.warnings.append(f"{edit_id} ({op}): id exists")
                return
            island = p.get("community_id")
            if p.get("new_island") == "true" or not island:
                taken = {n["community_id"] for n in self.nodes.values()}
                island = next(f"comm_user_{k}" for k in range(1, len(taken) + 2) if f"comm_user_{k}" not in taken)
            self.nodes[i] = {"id": i, "label": p["label"], "norm": _norm(p["label"]), "community_id": island, "origin": "user_added"}
        elif op == "add_edge":
            i = p.get("id") or self._free(f"ue-{seed}", self.edges)
            if i in self.edges:
                self.warnings.append(f"{edit_id} ({op}): id exists")
                return
            self.edges[i] = {"id": i, "from": p["from"], "to": p["to"], "label": p.get("label") or "", "glyph": p.get("glyph") or "wave", "origin": "user_added"}
        elif op == "delete_edge":
            del self.edges[target]
        else:
            e = self.edges[target]
            e["origin"] = "user_edited"
            if op == "relabel_edge":
                e["label"] = p.get("label") or ""
            elif op == "retype_edge":
                e["glyph"] = p["glyph"]
            else:
                e["from"], e["to"] = e["to"], e["from"]

    @staticmethod
    def _free(name: str, taken) -> str:
        return name if name not in taken else next(f"{name}-{k}" for k in range(2, len(taken) + 3) if f"{name}-{k}" not in taken)


def _norm(label: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFKC", label or "").strip().casefold()


def fold(nodes: DataFrame, edges: DataFrame, edits: DataFrame) -> DataFrame:
    """(session, kind, id, label, community_id, from, to, glyph, origin): the current graph; rows of kind ``warning`` for edits that did not apply.

    One session at a time, since an edit can depend on all earlier ones.
    """
    n = nodes.selectExpr("session", "'node' as kind", "id", "label", "community_id", "null as src", "null as dst", "null as glyph", "origin", "null as op", "null as target", "map() as payload", "0L as seq")
    e = edges.selectExpr("session", "'edge' as kind", "id", "label", "null as community_id", "`from` as src", "`to` as dst", "glyph", "origin", "null as op", "null as target", "map() as payload", "0L as seq")
    d = effective(edits).selectExpr("session", "'edit' as kind", "edit_id as id", "null as label", "null as community_id", "null as src", "null as dst", "null as glyph", "null as origin", "op", "target", "payload", "seq")
    text = ["label", "community_id", "src", "dst", "glyph", "origin", "op", "target"]
    cast = lambda f: f.withColumns({c: F.col(c).cast("string") for c in text} | {"payload": F.to_json(F.col("payload").cast("map<string,string>"))})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        rec = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        nodes_ = [{"id": r["id"], "label": r["label"], "norm": _norm(r["label"]), "community_id": r["community_id"], "origin": r["origin"]} for r in rec if r["kind"] == "node"]
        edges_ = [{"id": r["id"], "from": r["src"], "to": r["dst"], "label": r["label"], "glyph": r["glyph"], "origin": r["origin"]} for r in rec if r["kind"] == "edge"]
        g = Graph(nodes_, edges_)
        for r in sorted((r for r in rec if r["kind"] == "edit"), key=lambda r: r["seq"]):
            g.apply(r["id"], r["op"], r["target"], json.loads(r["payload"] or "{}"))
        s = rec[0]["session"]
        out = [(s, "node", n["id"], n["label"], n["community_id"], None, None, None, n["origin"]) for n in g.nodes.values()]
        out += [(s, "edge", e["id"], e["label"], None, e["from"], e["to"], e["glyph"], e["origin"]) for e in g.edges.values()]
        out += [(s, "warning", f"w{i:04d}", w, None, None, None, None, None) for i, w in enumerate(g.warnings)]
        return pd.DataFrame(out, columns=["session", "kind", "id", "label", "community_id", "src", "dst", "glyph", "origin"])

    out = cast(n).unionByName(cast(e)).unionByName(cast(d)).groupBy("session").applyInPandas(run, "session string, kind string, id string, label string, community_id string, src string, dst string, glyph string, origin string")
    return out.withColumnsRenamed({"src": "from", "dst": "to"})


def fold_edges_set_based(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """The fold of relabel, retype, reverse and delete of existing edges by sets: last label and glyph, parity of reversals."""
    e = effective(edits).where(F.col("op").isin(*EDGE_OPS))
    per = e.groupBy("session", F.col("target").alias("id")).agg(
        F.max_by(F.col("payload")["label"], F.when(F.col("op") == "relabel_edge", F.col("seq"))).alias("_l"), F.count_if(F.col("op") == "relabel_edge").alias("_nl"),
        F.max_by(F.col("payload")["glyph"], F.when(F.col("op") == "retype_edge", F.col("seq"))).alias("_g"), F.count_if(F.col("op") == "reverse_edge").alias("_r"), F.count_if(F.col("op") == "delete_edge").alias("_d"),
    )
    out = edges.join(per, ["session", "id"], "left").where("coalesce(_d, 0) = 0")
    turn = F.coalesce(F.col("_r") % 2, F.lit(0)) == 1
    return out.withColumns(
        {"_f": F.col("from"), "label": F.when(F.col("_nl") > 0, F.coalesce("_l", F.lit(""))).otherwise(F.col("label")), "glyph": F.coalesce("_g", "glyph"), "origin": F.when(F.col("_nl").isNotNull(), "user_edited").otherwise(F.col("origin"))}
    ).withColumns({"from": F.when(turn, F.col("to")).otherwise(F.col("_f")), "to": F.when(turn, F.col("_f")).otherwise(F.col("to"))}).drop("_l", "_nl", "_g", "_r", "_d", "_f")


def reconcile_policy(edges: DataFrame, plan_edges: DataFrame) -> DataFrame:
    """Edges with glyph and label of the previous plan, which the policy had decided; users' edges stay."""
    was = plan_edges.select("session", "id", F.col("glyph").alias("_g"), F.col("label").alias("_l"))
    user = F.coalesce("origin", F.lit("")).startswith("user")
    out = edges.join(was, ["session", "id"], "left")
    return out.withColumns({"glyph": F.when(~user & F.col("_g").isNotNull(), F.col("_g")).otherwise(F.col("glyph")), "label": F.when(~user & F.col("_g").isNotNull(), F.col("_l")).otherwise(F.col("label"))}).drop("_g", "_l")


def evaluation_of_edits(edits: DataFrame) -> DataFrame:
    """Click verdicts that edits imply: deleting or retyping an edge calls it incorrect."""
    return edits.where("op in ('delete_edge', 'retype_edge')").select("session", F.col("target").alias("edge_id"), F.lit("incorrect").alias("verdict"), "ts")


def learned_renames(log: DataFrame, norm=normalize_label) -> DataFrame:
    """Effective renames (session, from_label, to_label, ts, seq) by pair; automatic if a label has one new name only."""
    r = log.withColumns({"from_norm": norm(F.col("from_label")), "to_norm": norm(F.col("to_label"))}).where("from_norm <> '' and to_norm <> '' and from_norm <> to_norm")
    g = r.groupBy("from_norm", "to_norm").agg(F.count("*").alias("n"), F.max("ts").alias("ts"), F.min_by(F.struct("from_label", "to_label"), F.struct("session", "seq")).alias("x"), F.array_sort(F.collect_set("session")).alias("sessions"))
    return g.withColumn("auto", F.count("*").over(Window.partitionBy("from_norm")) == 1).select("from_norm", "to_norm", "x.*", "n", "ts", "sessions", "auto")


def learned_stoplist(log: DataFrame, norm=normalize_label, least: int = 2) -> DataFrame:
    """Deleted labels (session, label, ts, seq); automatic from ``least`` deletions."""
    return log.withColumn("label_norm", norm(F.col("label"))).where("label_norm <> ''").groupBy("label_norm").agg(F.count("*").alias("n"), F.max("ts").alias("ts"), F.array_sort(F.collect_set("session")).alias("sessions"), (F.count("*") >= least).alias("auto"))


def learned_overrides(log: DataFrame, norm=normalize_label) -> DataFrame:
    """Causal decisions on pairs from retyped, reversed and deleted edges: the last wins, all are counted.

    ``log``: session, seq, op, old_glyph, new_glyph, from_label, to_label, ts.
    """
    was, now = F.col("old_glyph") == "arrow", F.col("new_glyph") == "arrow"
    decision = (
        F.when((F.col("op") == "retype_edge") & was & ~now, "deny").when((F.col("op") == "retype_edge") & ~was & now, "allow")
        .when((F.col("op") == "reverse_edge") & was, "reverse").when((F.col("op") == "delete_edge") & was, "deny")
    )
    r = log.withColumns({"decision": decision, "from_norm": norm(F.col("from_label")), "to_norm": norm(F.col("to_label"))}).where("decision is not null and from_norm <> '' and to_norm <> ''")
    return r.groupBy("from_norm", "to_norm").agg(F.max_by(F.struct("decision", "session", "ts"), F.struct("session", "seq")).alias("x"), F.count("*").alias("n")).select("from_norm", "to_norm", "x.*", "n")


def cue_stats(kept: DataFrame, downgraded: DataFrame) -> DataFrame:
    """(cue, kept, downgraded_by_user)."""
    k = kept.groupBy("cue").agg(F.count("*").alias("kept"))
    d = downgraded.groupBy("cue").agg(F.count("*").alias("downgraded_by_user"))
    return k.join(d, "cue", "full").fillna(0)


def cue_warnings(stats: DataFrame, ratio: float = 0.5, least: int = 3) -> DataFrame:
    down, all_ = F.col("downgraded_by_user"), F.col("downgraded_by_user") + F.col("kept")
    return stats.where((down >= least) & (F.try_divide(down, all_) >= ratio))


def few_shot(items: DataFrame, most: int = FEW_SHOT) -> DataFrame:
    """Distinct texts, newest first, ``most`` of them."""
    return items.groupBy("text").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "text").limit(most)


def apply_learned(nodes: DataFrame, edges: DataFrame, renames: DataFrame, stoplist: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes renamed and stop-listed with their edges, edges with ``causal_override``; reversals turn an edge and allow it."""
    lex = renames.where("auto").select(F.col("from_norm").alias("_n"), F.col("to_label").alias("_to"))
    n = nodes.withColumn("_n", normalize_label(F.col("label"))).join(lex, "_n", "left").withColumn("label", F.coalesce("_to", "label")).drop("_n", "_to")
    stop = stoplist.where("auto").select(F.col("label_norm").alias("_n"))
    n = n.withColumn("_n", normalize_label(F.col("label"))).join(stop, "_n", "left_anti")
    e = edges
    for end in ("from", "to"):
        e = e.join(n.select("session", F.col("id").alias(end), F.col("_n").alias(f"{end}_norm")), ["session", end])
    e = e.join(overrides.select("from_norm", "to_norm", "decision"), ["from_norm", "to_norm"], "left")
    turn = F.coalesce(F.col("decision") == "reverse", F.lit(False))
    new = F.when(F.col("decision").isin("allow", "reverse"), "allow").when(F.col("decision") == "deny", "deny").otherwise(F.col("causal_override"))
    e = e.withColumns({"causal_override": new, "_f": F.col("from")}).withColumns({"from": F.when(turn, F.col("to")).otherwise(F.col("_f")), "to": F.when(turn, F.col("_f")).otherwise(F.col("to"))})
    return n.drop("_n"), e.drop("_f", "from_norm", "to_norm", "decision")


def prompt_hints(items: DataFrame, most: int = 10, chars: int = 600) -> DataFrame:
    """Half newest and half most frequent items (text, ts, n), once each, while their lengths fit."""
    top = lambda c: items.orderBy(F.desc(c), "text").limit(most // 2).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(c), "text")))
    new, often = top("ts").withColumn("_p", F.lit(0)), top("n").withColumn("_p", F.lit(1))
    one = new.unionByName(often).groupBy("text").agg(F.min(F.struct("_p", "_r")).alias("o"))
    w = Window.orderBy("o", "text")
    return one.withColumns({"pos": F.row_number().over(w), "used": F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))}).where((F.col("used") <= chars) & (F.col("pos") <= most)).drop("o")




def learned_summary(renames: DataFrame, stoplist: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row: how many renames, stopped labels and causal decisions were learned, and how many of them apply by themselves."""
    count = lambda df, name: df.agg(F.count("*").alias(name), F.count_if("auto").alias(f"{name}_auto"))
    kinds = overrides.agg(*(F.count_if(F.col("decision") == k).alias(f"overrides_{k}") for k in ("allow", "deny", "reverse")))
    return count(renames, "renames").join(count(stoplist, "stopped")).join(kinds)
