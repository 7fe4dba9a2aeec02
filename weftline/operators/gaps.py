"""Gap candidates of graphs, decisions on them and findings across sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relations import has_tag
from ..functions.text import evidence_text, find_causal_cues, normalize_label
from . import graph

COLUMNS = ("session", "gap_id", "status", "confidence", "presumed_type", "gap_type", "signal", "related_node_ids", "community_id")


def _gap(df: DataFrame, gap_id, confidence, presumed, kind: str, signal, related, community) -> DataFrame:
    return df.select("session", gap_id.alias("gap_id"), F.lit("candidate").alias("status"), F.lit(confidence).cast("double").alias("confidence") if isinstance(confidence, float) else confidence.alias("confidence"), presumed.alias("presumed_type"), F.lit(kind).alias("gap_type"), signal.alias("signal"), related.alias("related_node_ids"), community.alias("community_id"))


def structural(nodes: DataFrame, edges: DataFrame, isolated: int = 0, weak: int = 1) -> DataFrame:
    """Isolated and weakly linked nodes by distinct neighbours."""
    d = nodes.select("session", "id", "community_id").join(graph.degree(nodes, edges), ["session", "id"])
    alone = F.col("degree") <= isolated
    d = d.where(F.col("degree") <= weak)
    return _gap(
        d, F.concat(F.when(alone, "gap-isolated-").otherwise("gap-weak-"), "id"), F.when(alone, 0.75).otherwise(0.45), F.when(alone, "data").otherwise("unknown"), "structural",
        F.concat(F.lit("degree="), F.col("degree").cast("string")), F.array("id"), F.col("community_id"),
    )


def bridges(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of communities of a session with ``least`` members each and no edge between them."""
    n = nodes.select("session", "id", F.coalesce("community_id", F.lit("comm_000")).alias("c"))
    big = n.groupBy("session", "c").agg(F.count("*").alias("k"), F.slice(F.array_sort(F.collect_list("id")), 1, 2).alias("some")).where(F.col("k") >= least)
    pairs = graph.undirected(nodes, edges).select("session", "a", "b")
    for end in "ab":
        pairs = pairs.join(n.select("session", F.col("id").alias(end), F.col("c").alias(f"c{end}")), ["session", end])
    crossing = pairs.where("ca <> cb").select("session", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).distinct()
    x, y = (big.select("session", F.col("c").alias(s), F.col("some").alias(f"some_{s}")) for s in "xy")
    apart = x.join(y, "session").where("x < y").join(crossing, ["session", "x", "y"], "left_anti")
    return _gap(
        apart, F.concat_ws("-", F.lit("gap-bridge"), "x", "y"), 0.5, F.lit("true"), "structural", F.concat(F.lit("crossing_edges("), "x", F.lit(","), "y", F.lit(")=0")),
        F.concat("some_x", "some_y"), F.lit(None).cast("string"),
    )


def declared(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """Communities that the extraction itself marks as gaps."""
    c = communities.where("is_gap").select("session", F.col("id").alias("community_id"))
    m = nodes.groupBy("session", "community_id").agg(F.array_sort(F.collect_list("id")).alias("m"))
    c = c.join(m, ["session", "community_id"], "left")
    return _gap(c, F.concat(F.lit("gap-declared-"), "community_id"), 0.6, F.lit("true"), "structural", F.lit("community.is_gap=true"), F.coalesce("m", F.array().cast("array<string>")), F.col("community_id"))


def discourse(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with claims of which no incident edge is tagged ``method_of``."""
    n = nodes.withColumn("refs", F.size(F.filter(F.coalesce("claim_refs", F.array().cast("array<string>")), lambda r: r != ""))).where("refs > 0")
    ends = edges.select("session", F.explode(F.array_distinct(F.array("from", "to"))).alias("id"), has_tag(F.col("layer_tags"), "layer_B", "method_of").alias("method"))
    seen = ends.groupBy("session", "id").agg(F.count("*").alias("touching"), F.count_if("method").alias("methods"))
    n = n.join(seen, ["session", "id"], "left").where("coalesce(methods, 0) = 0")
    signal = F.concat(F.lit("claim_refs="), F.col("refs").cast("string"), F.lit(", layer_B:method_of=0/"), F.coalesce("touching", F.lit(0)).cast("string"))
    return _gap(n, F.concat(F.lit("gap-discourse-"), "id"), 0.55, F.lit("data"), "discourse", signal, F.array("id"), F.col("community_id"))


def causal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges tagged as causes that are not shown as such: refused, uncertain, or demoted."""
    status = F.coalesce("validation.status", F.lit(""))
    how = F.when(status == "rejected", 0.6).when(status == "uncertain", 0.5).when(F.col("causal_check.demoted_from") == "arrow", 0.45)
    e = edges.where(has_tag(F.col("layer_tags"), "layer_C", "causes") & (F.coalesce("glyph", F.lit("")) != "arrow")).withColumn("c", how).where("c is not null")
    e = e.join(nodes.select("session", F.col("id").alias("from"), "community_id"), ["session", "from"], "left")
    name = F.when(F.coalesce(F.col("id"), F.lit("")) != "", F.col("id")).otherwise(F.concat_ws("-", "from", "to"))
    signal = F.concat_ws(", ", F.lit("layer_C:causes"), F.concat(F.lit("glyph="), "glyph"), F.concat(F.lit("validation="), F.when(status != "", status).otherwise("none")), F.concat(F.lit("combined="), F.col("validation.combined").cast("string")))
    return _gap(e, F.concat(F.lit("gap-causal-"), name), F.col("c"), F.when(status == "rejected", "true").otherwise("unknown"), "causal", signal, F.array("from", "to"), F.col("community_id"))


def detect(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """All gap candidates; in their order by falling confidence, then id (``rank``)."""
    out = structural(nodes, edges)
    for part in (bridges(nodes, edges), declared(nodes, communities), discourse(nodes, edges), causal(nodes, edges)):
        out = out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("confidence"), "gap_id")))


def decide(gaps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with their first decision (session, gap_id, decision, user_id, ts, seq); a decided gap stays as it is."""
    first = decisions.where("decision in ('confirm', 'dismiss')").groupBy("session", "gap_id").agg(F.min_by(F.struct("decision", "user_id", "ts"), "seq").alias("d"))
    out = gaps.join(first, ["session", "gap_id"], "left")
    fresh = (F.col("status") == "candidate") & F.col("d").isNotNull()
    status = F.when(fresh & (F.col("d.decision") == "confirm"), "confirmed").when(fresh, "dismissed").otherwise(F.col("status"))
    return out.withColumns({"status": status, "confirmed_by": F.when(fresh, F.col("d.user_id")), "confirmed_at": F.when(fresh, F.col("d.ts"))}).drop("d")


def carry_decisions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Freshly detected gaps with the status that their former selves have."""
    was = old.where("status <> 'candidate'").select("session", "gap_id", F.col("status").alias("_s"))
    return new.join(was, ["session", "gap_id"], "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def usefulness(gaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confirmed among decided gaps; null if none is decided."""
    c, d = F.count_if(F.col("status") == "confirmed"), F.count_if(F.col("status") == "dismissed")
    return gaps.groupBy(*(by or [])).agg(F.count("*").alias("total_candidates"), (c + d).alias("decided"), c.alias("confirmed"), d.alias("dismissed"), F.round(F.try_divide(c, c + d), 3).alias("usefulness_rate"))


def both_sides(mentions: DataFrame) -> DataFrame:
    """(gap_id, session, side) of mentions (gap_id, side left/right, session): both, left or right."""
    return mentions.groupBy("gap_id", "session").agg(F.when(F.count_distinct("side") == 2, "both").otherwise(F.min("side")).alias("side"))


def mentions(labels: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label_norm, session, node_id, document_id, surface) where concepts are mentioned: in spans of the node and of its edges, else the concept alone."""
    l = labels.select(normalize_label(F.col("label")).alias("label_norm")).distinct()  # noqa: E741
    hit = nodes.withColumn("label_norm", normalize_label(F.col("label"))).join(l, "label_norm", "left_semi").select("label_norm", "session", F.col("id").alias("node_id"), "evidence_span")
    own = hit.select("label_norm", "session", "node_id", F.explode("evidence_span").alias("s"))
    ends = edges.select("session", F.explode(F.array("from", "to")).alias("node_id"), F.col("evidence_span").alias("es"))
    near = hit.drop("evidence_span").join(ends, ["session", "node_id"]).select("label_norm", "session", "node_id", F.explode("es").alias("s"))
    spans = own.unionByName(near).select("label_norm", "session", "node_id", F.col("s.document_id").alias("document_id"), F.col("s.surface").alias("surface")).distinct()
    bare = hit.select("label_norm", "session", "node_id").join(spans, ["session", "node_id"], "left_anti").withColumns({"document_id": F.lit(None).cast("string"), "surface": F.lit(None).cast("string")})
    return spans.unionByName(bare)


def mechanism_spans(pairs: DataFrame, edges: DataFrame, terms: tuple[str, ...] = ("mechanism", "intervention", "counterfactual")) -> DataFrame:
    """Edges of all sessions between two labels (gap_id, a, b) whose evidence has a mechanism cue; dropped if it names neither label."""
    e = edges.select("session", "id", "from_label", "to_label", evidence_text(F.col("evidence_span")).alias("text"))
    e = e.withColumn("cues", F.filter(find_causal_cues(F.col("text")), lambda c: F.split(c, ":")[0].isin(*terms))).where(F.size("cues") > 0)
    met = pairs.join(e, ((pairs.a == e.from_label) & (pairs.b == e.to_label)))
    back = pairs.join(e, ((pairs.a == e.to_label) & (pairs.b == e.from_label)))
    out = met.unionByName(back)
    named = (F.col("a") == "") | (F.col("b") == "") | F.lower("text").contains(F.lower("a")) | F.lower("text").contains(F.lower("b"))
    return out.where(named)


def round_robin(gaps: DataFrame) -> DataFrame:
    """Gaps in turn by type (structural, discourse, causal), each by falling confidence: ``turn``."""
    kind = F.when(F.col("gap_type") == "structural", 0).when(F.col("gap_type") == "discourse", 1).otherwise(2)
    rn = F.row_number().over(Window.partitionBy("session", "gap_type").orderBy(F.desc("confidence"), "gap_id"))
    g = gaps.withColumns({"_rn": rn, "_k": kind})
    return g.withColumn("turn", F.row_number().over(Window.partitionBy("session").orderBy("_rn", "_k"))).drop("_rn", "_k")


def first_sources(rows: DataFrame, limit: int = 6) -> DataFrame:
    """The first ``limit`` distinct (kind, session, document_id, label) of every gap, by ``pos``."""
    one = rows.groupBy("gap_id", "kind", "session", "document_id", "label").agg(F.min("pos").alias("pos"))
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("gap_id").orderBy("pos"))).where(F.col("_r") <= limit).drop("_r")


def report(gaps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Gaps in turn with the sources that mention their concepts in any session."""
    ids = gaps.select("session", "gap_id", F.explode("related_node_ids").alias("id")).join(nodes.select("session", "id", "label"), ["session", "id"])
    seen = mentions(ids.select("label"), nodes, edges).groupBy("label_norm").agg(F.count_distinct("session").alias("sessions"), F.count("document_id").alias("spans"))
    per = ids.withColumn("label_norm", normalize_label(F.col("label"))).join(seen, "label_norm", "left").groupBy("session", "gap_id").agg(F.max("sessions").alias("sessions"), F.sum("spans").alias("spans"))
    return round_robin(gaps).join(per, ["session", "gap_id"], "left")


def counts_by_type(gaps: DataFrame) -> DataFrame:
    """(session, structural, discourse, causal, total) of the candidates."""
    return gaps.groupBy("session").agg(*(F.count_if(F.col("gap_type") == k).alias(k) for k in ("structural", "discourse", "causal")), F.count("*").alias("total"))


def report_markdown(report: DataFrame, title: str) -> DataFrame:
    """(session, text): the report of a session as Markdown, its gaps in turn."""
    line = F.concat(F.lit("- **"), "gap_id", F.lit("** ("), "gap_type", F.lit(", "), F.round("confidence", 2).cast("string"), F.lit("): "), F.coalesce("signal", F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return report.groupBy("session").agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(rows, "\n"), F.lit("\n")).alias("text"))


def save_report(report: DataFrame, path: str, title: str) -> None:
    """The report below ``path``, a folder for each session: ``json`` with a row a gap and ``markdown``."""
    report.write.mode("overwrite").partitionBy("session").json(f"{path}/json")
    report_markdown(report, title).write.mode("overwrite").partitionBy("session").option("lineSep", "\n").text(f"{path}/markdown")
