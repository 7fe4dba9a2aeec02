"""Corpus graph, search, neighbourhood, gaps and levels over the derived graph."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.relations import combine_scores, judge, normalize_tags, policy_stats, project_glyph
from ..functions.text import ascii_norm
from ..operators import community, corpus, evaluate, gaps, graph, levels, reach, repair
from ..session import table
from ..sources import trigram
from ..sources.files import cut, shared_dir
from . import demo
from .registry import query


def _spanless(df):
    return df.withColumn("evidence_span", F.array().cast("array<struct<document_id:string,char_start:int,char_end:int,surface:string>>"))


@query(demo.duckdb("""SELECT lower(trim(from_label)) AS from_norm, lower(trim(to_label)) AS to_norm, glyph, count(*) AS weight, arg_max(label, session || '|' || (1000000 - CAST(substr(id, 2) AS INTEGER))) AS label
    FROM e GROUP BY 1, 2, 3"""))  # fmt: skip
def corpus_edge_merge(spark, sf_dir):
    """A3: edges of all sessions merged on (from, to, glyph), with the newest session's first label."""
    e = demo.numbered(spark, sf_dir).withColumns({"from_norm": ascii_norm(F.col("from_label")), "to_norm": ascii_norm(F.col("to_label"))})
    newest = F.struct(F.col("session"), -F.substring("id", 2, 10).cast("int"))
    return e.groupBy("from_norm", "to_norm", "glyph").agg(F.count("*").alias("weight"), F.max_by("label", newest).alias("label"))


@query(demo.duckdb("""SELECT lower(label) AS label_norm, arg_max(label, session) AS label, count(*) AS sources, max(session) AS newest FROM n GROUP BY 1"""))
def corpus_node_merge(spark, sf_dir):
    """A2: nodes of all sessions merged on the normalised label."""
    n = demo.nodes(spark, sf_dir).withColumn("onto_class", F.lit(""))
    m = corpus.merge_nodes(n, ascii_norm)
    return m.select("label_norm", "label", F.size("sources").cast("long").alias("sources"), F.get("sources", F.lit(0))["session"].alias("newest"))


@query(demo.duckdb("""SELECT session, least("from", "to") AS a, greatest("from", "to") AS b, round(sum(CASE WHEN coalesce(confidence, 0) = 0 THEN 1 ELSE confidence END), 4) AS weight, count(*) AS n
    FROM g WHERE "from" <> "to" GROUP BY 1, 2, 3"""))  # fmt: skip
def undirected_projection(spark, sf_dir):
    """A1: the simple weighted graph of every session."""
    return graph.undirected(demo.nodes(spark, sf_dir), demo.edges(spark, sf_dir)).withColumn("weight", F.round("weight", 4))


_SPARSE = demo.BASE + """, ends AS (SELECT session, "from" AS id, "to" AS other FROM sp UNION ALL SELECT session, "to", "from" FROM sp),
deg AS (SELECT nw.session, nw.id, nw.community_id, count(DISTINCT other) AS degree, count(other) AS incident FROM nw LEFT JOIN ends USING (session, id) GROUP BY 1, 2, 3)"""


@query(demo.duckdb("SELECT session, id, degree, incident FROM deg", _SPARSE))
def node_degrees(spark, sf_dir):
    """A5: distinct neighbours and incident rows."""
    return graph.degree(demo.nodes(spark, sf_dir, True), demo.ends(spark, sf_dir, True))


@query(demo.duckdb("""SELECT least(from_label, to_label) AS a, greatest(from_label, to_label) AS b, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY 1, 2"""))
def corpus_undirected_weights(spark, sf_dir):
    """A4: corpus weights over both directions and all glyphs."""
    e = demo.relation(spark, sf_dir, "e").select(F.col("from_label").alias("from_norm"), F.col("to_label").alias("to_norm"), "glyph")
    return corpus.undirected_weights(e.groupBy("from_norm", "to_norm", "glyph").agg(F.count("*").alias("weight")))


_SEARCH = demo.duckdb("""SELECT CAST(rank AS BIGINT) AS rank, kind, session, id, label, exact FROM (
    SELECT 'node' AS kind, session, id, label, exact, row_number() OVER (ORDER BY exact DESC, session DESC, lower(label), id) AS rank FROM (SELECT session, id, label, lower(label) = 'supplier#000000001' AS exact FROM nw WHERE contains(lower(label), 'supplier#000000001')) x
    UNION ALL SELECT 'edge', session, id, label, false, row_number() OVER (ORDER BY session DESC, lower(f), lower(t), id) + (SELECT count(*) FROM nw WHERE contains(lower(label), 'supplier#000000001')) AS rank
    FROM (SELECT session, id, label, "from" AS f, "to" AS t FROM sp WHERE contains(lower(label || chr(10) || "to"), 'supplier#000000001')) z) y WHERE rank <= 500""")  # fmt: skip


@query(_SEARCH)
def label_search(spark, sf_dir):
    """Substring search, exact labels first, then the newest session; edges with the text in their evidence fill up."""
    return corpus.search(*_searched(spark, sf_dir), "Supplier#000000001", 500).withColumn("rank", F.col("rank").cast("long"))


def _searched(spark, sf_dir, **kept):
    n = demo.nodes(spark, sf_dir, True).select("session", F.col("id").alias("node_id"), "label", ascii_norm(F.col("label")).alias("label_norm"), F.lit(0.0).alias("importance"))
    e = demo.edges(spark, sf_dir, True, **kept).select("session", F.col("id").alias("edge_id"), ascii_norm(F.col("from")).alias("from_norm"), ascii_norm(F.col("to")).alias("to_norm"), "label", F.col("to").alias("evidence"))
    return n, e


@query(_SEARCH)
def indexed_search(spark, sf_dir):
    """The same by a stored trigram index, written for the query."""
    path = f"{shared_dir(spark).rstrip('/')}/indexes/{uuid.uuid4().hex}"
    trigram.build_search(*_searched(spark, sf_dir, attributes=("label",), once=True), path)
    return trigram.search(spark, path, "Supplier#000000001", 500).withColumn("rank", F.col("rank").cast("long"))


@query(demo.duckdb("""SELECT session, id, min(hop) AS hop FROM (
      SELECT session, id, 0 AS hop FROM nw WHERE id = 'Supplier#000000001' UNION ALL SELECT session, other, 1 FROM ends WHERE id = 'Supplier#000000001'
      UNION ALL SELECT a.session, b.other, 2 FROM ends a JOIN ends b ON a.session = b.session AND a.other = b.id WHERE a.id = 'Supplier#000000001') x GROUP BY 1, 2""", _SPARSE))  # fmt: skip
def two_hop_neighborhood(spark, sf_dir):
    """GR3: nodes within two hops of a seed in every session."""
    n = demo.nodes(spark, sf_dir, True)
    return graph.spread(n, demo.ends(spark, sf_dir, True), n.where("id = 'Supplier#000000001'"), 2).select("session", "id", "hop")


@query(demo.duckdb("""SELECT session, CASE WHEN degree = 0 THEN 'gap-isolated-' ELSE 'gap-weak-' END || id AS gap_id, CAST(CASE WHEN degree = 0 THEN 0.75 ELSE 0.45 END AS DOUBLE) AS confidence,
    CASE WHEN degree = 0 THEN 'data' ELSE 'unknown' END AS presumed_type, 'degree=' || degree AS signal FROM deg WHERE degree <= 1""", _SPARSE))  # fmt: skip
def gaps_structural(spark, sf_dir):
    """GR7: isolated and weakly linked nodes."""
    return gaps.structural(demo.nodes(spark, sf_dir, True), demo.ends(spark, sf_dir, True)).select("session", "gap_id", "confidence", "presumed_type", "signal")


@query(demo.duckdb("""SELECT x.session, 'gap-bridge-' || x.c || '-' || y.c AS gap_id FROM
    (SELECT DISTINCT session, community_id AS c FROM nw) x JOIN (SELECT DISTINCT session, community_id AS c FROM nw) y ON x.session = y.session AND x.c < y.c
    LEFT JOIN (SELECT DISTINCT sp.session, least(a.community_id, b.community_id) AS lo, greatest(a.community_id, b.community_id) AS hi FROM sp JOIN nw a ON a.session = sp.session AND a.id = sp."from" JOIN nw b ON b.session = sp.session AND b.id = sp."to") l
        ON l.session = x.session AND l.lo = x.c AND l.hi = y.c WHERE l.session IS NULL""", _SPARSE))  # fmt: skip
def gaps_bridges(spark, sf_dir):
    """GR7: pairs of communities without an edge between them."""
    return gaps.bridges(demo.nodes(spark, sf_dir, True), demo.edges(spark, sf_dir, True)).select("session", "gap_id")


@query(demo.duckdb("""SELECT session, community_id, arg_min(id, printf('%08d', 10000000 - incident) || id) AS id FROM deg GROUP BY 1, 2""", _SPARSE))
def community_representatives(spark, sf_dir):
    """GR11: the node with most incident rows."""
    return graph.representative(demo.nodes(spark, sf_dir, True), demo.ends(spark, sf_dir, True))


_RANKED = _SPARSE + """, r0 AS (SELECT session, id, community_id AS community, incident,
    CASE WHEN max(incident) OVER (PARTITION BY session) = min(incident) OVER (PARTITION BY session) THEN 0.5
         ELSE (incident - min(incident) OVER (PARTITION BY session)) * 1.0 / (max(incident) OVER (PARTITION BY session) - min(incident) OVER (PARTITION BY session)) END AS total FROM deg)"""


def _ranked(spark, sf_dir, wide=True):
    n = demo.nodes(spark, sf_dir, wide)
    d = graph.degree(n, demo.ends(spark, sf_dir, wide)).join(n, ["session", "id"])
    d = cut(d.select("session", "id", F.col("community_id").alias("community"), F.col("incident").cast("double").alias("incident"), F.lit(False).alias("pinned")))
    return levels.scaled(d, "incident", ["session"], "total").select("session", "id", "community", "total", "pinned")


@query(demo.duckdb("SELECT session, id, round(total, 6) AS total FROM r0", _RANKED))
def min_max_scaling(spark, sf_dir):
    """Min-max scaling per session."""
    return _ranked(spark, sf_dir).select("session", "id", F.round("total", 6).alias("total"))


@query(demo.duckdb("""SELECT session, id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY cls, CASE WHEN cls = 1 THEN -size ELSE 0 END, CASE WHEN cls = 1 THEN community ELSE '' END, total DESC, id) AS rank FROM (
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY session, community ORDER BY total DESC, id) = 1 THEN 1 ELSE 2 END AS cls, count(*) OVER (PARTITION BY session, community) AS size FROM r0) x) y WHERE rank <= 40""", _RANKED))  # fmt: skip
def quota_top_k(spark, sf_dir):
    """One node per community first, then by rank."""
    return levels.select_k(_ranked(spark, sf_dir), 40).select("session", "id")


@query("""SELECT level, total, CASE WHEN total <= lo THEN total ELSE least(hi, total, greatest(lo, CAST(round_even(ratio * total, 0) AS INTEGER))) END AS k
    FROM (VALUES ('overview', 10, 20, 0.35), ('standard', 20, 50, 0.7), ('detailed', 50, 100, 1.0)) AS l(level, lo, hi, ratio), (SELECT CAST(p_size * 4 AS INTEGER) AS total FROM part GROUP BY p_size) t""")
def level_targets(spark, sf_dir):
    """How many nodes a level shows."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") * 4).cast("int").alias("total")).distinct()
    out = None
    for lv in ("overview", "standard", "detailed"):
        one = t.select(F.lit(lv).alias("level"), "total", levels.target_count(lv, F.col("total")).alias("k"))
        out = one if out is None else out.unionByName(one)
    return out


_VISIBLE = _RANKED + """, vis AS (SELECT session, id, community FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY total DESC, id) AS rk FROM r0) v WHERE rk <= 100),
hid AS (SELECT r0.* FROM r0 LEFT JOIN vis USING (session, id) WHERE vis.id IS NULL),
agg AS (SELECT session, community, 'agg-' || community AS agg_id, count(*) AS members, arg_min(id, printf('%012.8f', 1 - total) || id) AS representative FROM hid GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _visible(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    top = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("total"), "id"))
    return r, r.withColumn("rk", top).where("rk <= 100").select("session", F.lit("overview").alias("level"), "id")


@query(demo.duckdb("SELECT session, agg_id AS id, members, representative FROM agg", _VISIBLE))
def hidden_aggregates(spark, sf_dir):
    """A10: hidden members folded per community."""
    r, v = _visible(spark, sf_dir)
    a = levels.build_aggregates(_spanless(demo.nodes(spark, sf_dir, True)), r, v)
    return a.select("session", "id", F.size("members").cast("long").alias("members"), "representative")


@query(demo.duckdb("""SELECT session, f AS "from", t AS "to", min(id) AS id, count(*) AS members, arg_min(glyph, printf('%06.3f', 2 - c) || id) AS glyph FROM (
    SELECT sp.session, sp.id, sp.glyph, CASE WHEN coalesce(sp.confidence, 0) = 0 THEN 0.5 ELSE sp.confidence END AS c, s1.shown AS f, s2.shown AS t FROM sp
    JOIN (SELECT session, id, id AS shown FROM vis UNION ALL SELECT hid.session, hid.id, agg_id FROM hid JOIN agg USING (session, community)) s1 ON s1.session = sp.session AND s1.id = sp."from"
    JOIN (SELECT session, id, id AS shown FROM vis UNION ALL SELECT hid.session, hid.id, agg_id FROM hid JOIN agg USING (session, community)) s2 ON s2.session = sp.session AND s2.id = sp."to") x
    WHERE f <> t GROUP BY 1, 2, 3""", _VISIBLE))  # fmt: skip
def level_edges(spark, sf_dir):
    """Edges moved to aggregates and merged, with the surest glyph."""
    r, v = _visible(spark, sf_dir)
    a = levels.build_aggregates(_spanless(demo.nodes(spark, sf_dir, True)), r, v)
    e = levels.level_edges(demo.edges(spark, sf_dir, True, ("label", "glyph", "confidence")), v, a)
    return e.select("session", "from", "to", "id", F.size("member_edge_ids").cast("long").alias("members"), "glyph")


@query(demo.duckdb("""SELECT session, "from", "to", glyph, min(id) AS id, count(*) AS merged, max(confidence) AS confidence FROM g GROUP BY session, "from", "to", glyph, lower(trim(brand))"""))
def duplicate_edges_merged(spark, sf_dir):
    """Semantic duplicates of edges merged."""
    e = _spanless(demo.edges(spark, sf_dir).withColumn("label", F.col("brand")))
    return repair.merge_duplicate_edges(e, ascii_norm).select("session", "from", "to", "glyph", "id", "merged", "confidence")


@query(demo.duckdb("""SELECT session, id, CASE WHEN quantity % 7 = 0 AND NOT has_tags THEN glyph WHEN d = 'refutes' THEN 'zigzag' WHEN c = 'causes' AND confidence >= 0.95 THEN 'arrow' WHEN d = 'questions' THEN 'question'
    WHEN c = 'precedes' THEN 'precedes' WHEN a = 'is_a' THEN 'isa' WHEN a = 'part_of' THEN 'partof' WHEN d IN ('corroborates', 'agrees_with') THEN 'double' WHEN has_tags THEN 'wave' ELSE glyph END AS shown FROM (
    SELECT *, a IS NOT NULL OR c IS NOT NULL OR d IS NOT NULL AS has_tags FROM (SELECT *, CASE WHEN quantity = 3 THEN 'refutes' WHEN quantity = 4 THEN 'questions' WHEN quantity = 5 THEN 'agrees_with' END AS d,
      CASE WHEN glyph = 'arrow' THEN 'causes' WHEN glyph = 'wave' AND quantity > 25 THEN 'precedes' END AS c, CASE WHEN glyph = 'isa' THEN 'is_a' WHEN quantity = 9 THEN 'part_of' END AS a FROM g) x) y"""))  # fmt: skip
def glyph_projection(spark, sf_dir):
    """The shown glyph by the ordered rules over the layer tags."""
    q, g = F.col("quantity"), F.col("glyph")
    one = lambda c: F.array_compact(F.array(c))
    tags = F.map_from_arrays(F.array(F.lit("A"), F.lit("layer-c"), F.lit("layerD")), F.array(
        one(F.when(g == "isa", "is_a").when(q == 9, "part-of")), one(F.when(g == "arrow", "Causes").when((g == "wave") & (q > 25), "precedes")),
        one(F.when(q == 3, "refutes").when(q == 4, "questions").when(q == 5, "agrees with")),
    ))
    e = demo.edges(spark, sf_dir).withColumn("layer_tags", normalize_tags(tags))
    return e.select("session", "id", project_glyph(g, F.lit(None).cast("string"), F.col("layer_tags"), F.col("confidence") >= 0.95).alias("shown"))


@query(demo.duckdb("""SELECT session, id, combined, CASE WHEN combined >= 0.75 AND nli IS NOT NULL THEN 'validated' WHEN combined >= 0.5 THEN 'uncertain' ELSE 'rejected' END AS status FROM (
    SELECT session, id, nli, round((coalesce(0.4 * nli, 0) + 0.25 * onto) / (CASE WHEN nli IS NULL THEN 0 ELSE 0.4 END + 0.25), 4) AS combined FROM (
      SELECT session, id, CASE WHEN quantity > 10 THEN confidence END AS nli, CASE WHEN tax > 0.04 THEN 1.0 WHEN tax > 0.02 THEN 0.5 ELSE 0.0 END AS onto FROM g) x) y"""))  # fmt: skip
def verifier_scores(spark, sf_dir):
    """Scores combined over the verifiers that ran, and the judgement."""
    e = demo.edges(spark, sf_dir)
    s = {"nli": F.when(F.col("quantity") > 10, F.col("confidence")), "ontology": F.when(F.col("tax") > 0.04, 1.0).when(F.col("tax") > 0.02, 0.5).otherwise(0.0)}
    return e.select("session", "id", combine_scores(s).alias("combined"), judge(s)["status"].alias("status"))


@query(demo.duckdb("""SELECT glyph, session, id AS edge_id FROM (SELECT *, row_number() OVER (PARTITION BY glyph ORDER BY session DESC, id DESC) AS rk FROM g) p JOIN (
    SELECT glyph AS gg, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, glyph) <= 50 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM (
      SELECT glyph, n, floor(n * 50 / total) AS base, n * 50 / total - floor(n * 50 / total) AS rest FROM (SELECT glyph, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM g GROUP BY glyph) a) b) q ON glyph = gg WHERE rk <= quota"""))  # fmt: skip
def stratified_queue(spark, sf_dir):
    """50 relations by largest remainder over the glyphs."""
    return evaluate.stratified(demo.edges(spark, sf_dir).select("glyph", "session", F.col("id").alias("edge_id")), 50)


@query(demo.duckdb("""SELECT count_if(glyph = 'arrow' AND quantity <= 40) AS causal_kept, count_if(glyph = 'arrow' AND quantity > 40) AS causal_demoted, count_if(glyph <> 'arrow') AS unchanged FROM g"""))
def relation_policy(spark, sf_dir):
    """Causal edges need a cue; here every label has one and the verifier refuses large quantities."""
    from ..functions.relations import apply_relation_policy

    e = _spanless(demo.relation(spark, sf_dir, "g").select("session", "from", "to", "label", "glyph", "confidence", "quantity")).withColumn("causal_override", F.lit(None).cast("string")).withColumn("label", F.concat(F.lit("leads to "), "label"))
    return policy_stats(apply_relation_policy(e, verdict=F.col("quantity") <= 40)).select("causal_kept", "causal_demoted", "unchanged")


@query(demo.duckdb("""SELECT session, community, "from", "to", glyph, CAST(rank AS INTEGER) AS rank FROM (SELECT sp.session, a.community_id AS community, sp."from", sp."to", sp.glyph,
    row_number() OVER (PARTITION BY sp.session, a.community_id ORDER BY sp."from", sp."to", sp.glyph, sp.id) AS rank FROM sp
    JOIN nw a ON a.session = sp.session AND a.id = sp."from" JOIN nw b ON b.session = sp.session AND b.id = sp."to" AND b.community_id = a.community_id) x WHERE rank <= 3""", _SPARSE))  # fmt: skip
def community_relations(spark, sf_dir):
    """GR12: the first relations inside each community of every session."""
    n = demo.nodes(spark, sf_dir, True).select(F.concat_ws("|", "session", "community_id").alias("community"), F.concat_ws("|", "session", "id").alias("id"))
    e = demo.edges(spark, sf_dir, True).select("session", "id", F.concat_ws("|", "session", "from").alias("from"), F.concat_ws("|", "session", "to").alias("to"), "glyph")
    out = graph.community_relations(e, n, 3)
    last = lambda c: F.element_at(F.split(c, "[|]"), -1)
    return out.select("session", last("community").alias("community"), last("from").alias("from"), last("to").alias("to"), "glyph", "rank")


@query("""SELECT a AS id, min(b) AS component FROM (WITH RECURSIVE p AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION SELECT 'c' || c_custkey, 'b' || CAST(floor(c_acctbal) AS INTEGER) FROM customer),
    u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w AS (SELECT a, a AS b FROM u UNION SELECT w.a, u.b FROM w JOIN u ON w.b = u.a) SELECT a, b FROM w) x GROUP BY 1""")
def graph_components(spark, sf_dir):
    """Connected components of all orders, their customers and equal balances."""
    pair = lambda t, a, b, x, y: t.select(F.concat(F.lit(x), F.col(a).cast("string")).alias("a"), F.concat(F.lit(y), b.cast("string")).alias("b"))
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    p = pair(o, "o_orderkey", F.col("o_custkey"), "o", "c").unionByName(pair(c, "c_custkey", F.floor("c_acctbal").cast("int"), "c", "b"))
    return graph.connected_components(p.distinct())


@query()
def session_betweenness(spark, sf_dir):
    """GR2: exact betweenness per session (unit-tested)."""
    return graph.betweenness(demo.nodes(spark, sf_dir), demo.edges(spark, sf_dir))


#: Three terms of every question that a user asks; the newest three sessions with a term's node are its hits.
_ASKED = """, q AS (SELECT conv_id * 1000 + turn AS question, length(text) % 25 AS t1, conv_id % 25 AS t2, (conv_id + turn) % 25 AS t3 FROM conversations WHERE role = 'user' AND text IS NOT NULL),
asked AS (SELECT question, 1 AS term_pos, 'NATION_' || CAST(t1 AS VARCHAR(3)) AS term FROM q UNION ALL SELECT question, 2, 'NATION_' || CAST(t2 AS VARCHAR(3)) FROM q UNION ALL SELECT question, 3, 'NATION_' || CAST(t3 AS VARCHAR(3)) FROM q)"""
_LOCAL = demo.BASE + _ASKED + """, act AS (SELECT DISTINCT session, "to" AS id FROM g), hit AS (SELECT * FROM (SELECT session, id, row_number() OVER (PARTITION BY id ORDER BY session DESC) AS rank FROM act) z WHERE rank <= 3),
sd AS (SELECT * FROM (SELECT question, session, id, row_number() OVER (PARTITION BY question ORDER BY o, session, id) AS place FROM (SELECT question, session, hit.id, min(term_pos * 100 + rank) AS o FROM asked JOIN hit ON hit.id = term GROUP BY 1, 2, 3) a) b WHERE place <= 8),
uu AS (SELECT DISTINCT session, "from" AS a, "to" AS b FROM g UNION SELECT session, "to", "from" FROM g),
h1 AS (SELECT DISTINCT question, sd.session, b AS id FROM sd JOIN uu ON uu.session = sd.session AND a = id),
h2 AS (SELECT DISTINCT question, h1.session, b AS id FROM h1 JOIN uu ON uu.session = h1.session AND a = id),
near AS (SELECT question, session, id, min(hop) AS hop FROM (SELECT question, session, id, 0 AS hop FROM sd UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) c GROUP BY 1, 2, 3),
ranked AS (SELECT near.*, row_number() OVER (PARTITION BY near.question ORDER BY turn, near.session, hop, id) AS place, count(*) OVER (PARTITION BY near.question) AS total FROM near
    JOIN (SELECT question, session, min(place) AS turn FROM sd GROUP BY 1, 2) f ON f.question = near.question AND f.session = near.session)"""


def _materials(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    q = conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question"), F.array((F.length("text") % 25).cast("string"), (F.col("conv_id") % 25).cast("string"), ((F.col("conv_id") + F.col("turn")) % 25).cast("string")).alias("t"))
    asked = q.select("question", F.posexplode("t").alias("term_pos", "k")).select("question", "term_pos", F.concat(F.lit("NATION_"), "k").alias("term"))
    # Edges with the same ends count as one with their number and their first id.
    n, e = demo.nodes(spark, sf_dir), cut(demo.edges(spark, sf_dir).groupBy("session", "from", "to").agg(F.count("*").alias("edges"), F.min("id").alias("id")))
    hit = e.select("session", F.col("to").alias("id")).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("session")))).where("rank <= 3")
    hits = asked.join(hit, F.col("term") == F.col("id")).select("question", "term_pos", "rank", "session", "id", F.lit("node").alias("kind"))
    return corpus.local_materials(n, e, corpus.seeds(hits, 8))


@query(demo.duckdb("SELECT question, CAST(place AS INTEGER) AS place, session, id, hop, hop = 0 AS seed, total > 40 AS truncated FROM ranked WHERE place <= 40", _LOCAL))
def local_concepts(spark, sf_dir):
    """The concepts for every question of all conversations, forty at most, over the sessions in the order of their seeds."""
    return _materials(spark, sf_dir)[0]


@query(demo.duckdb("""SELECT x.question, count(*) AS relations, count(DISTINCT g.session) AS sessions, min(g.id) AS first FROM ranked x JOIN g ON g.session = x.session AND g."from" = x.id AND g."from" <> g."to"
    JOIN ranked y ON y.question = x.question AND y.session = x.session AND y.id = g."to" WHERE x.place <= 40 AND y.place <= 40 GROUP BY 1""", _LOCAL))  # fmt: skip
def local_relations(spark, sf_dir):
    """The relations between the concepts of every question."""
    return _materials(spark, sf_dir)[1].groupBy("question").agg(F.sum("edges").alias("relations"), F.count_distinct("session").alias("sessions"), F.min("id").alias("first"))


_HOPS = 6


def _shortest_paths() -> str:
    """SQL of the levels l0, l1, ... of shortest paths from the pivots over edges u, and of the dependencies s0, s1, ... back."""
    out = ["l0 AS (SELECT origin, origin AS id, CAST(1 AS DOUBLE) AS paths FROM pv)"]
    for i in range(1, _HOPS + 1):
        seen = " UNION ALL ".join(f"SELECT origin, id FROM l{j}" for j in range(i))
        out.append(f"l{i} AS (SELECT origin, b AS id, sum(paths) AS paths FROM l{i - 1} JOIN u ON a = id WHERE (origin, b) NOT IN ({seen}) GROUP BY 1, 2)")
    out.append(f"s{_HOPS} AS (SELECT *, CAST(0 AS DOUBLE) AS share FROM l{_HOPS})")
    for i in range(_HOPS - 1, 0, -1):
        flow = f"SELECT origin, b AS id, sum((1 + share) / paths) AS x FROM s{i + 1} JOIN u ON a = id GROUP BY 1, 2"
        out.append(f"s{i} AS (SELECT l.origin, l.id, l.paths, l.paths * coalesce(x, 0) AS share FROM l{i} l LEFT JOIN ({flow}) f ON f.origin = l.origin AND f.id = l.id)")
    return ",\n".join(out)


_PIVOTS = demo.BASE + """, pairs AS (SELECT DISTINCT "from" AS a, "to" AS b FROM sp), u AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), ids AS (SELECT DISTINCT a AS id FROM u),
pv AS (SELECT id AS origin FROM ids ORDER BY md5(id), id LIMIT 16), """ + _shortest_paths()


@query(demo.duckdb(f"""SELECT ids.id, round(coalesce(share, 0) * n / 16 / ((n - 1) * (n - 2)), 8) AS betweenness FROM ids, (SELECT count(*) AS n FROM ids) c
    LEFT JOIN (SELECT id, sum(share) AS share FROM ({' UNION ALL '.join(f'SELECT id, share FROM s{i}' for i in range(1, _HOPS + 1))}) z GROUP BY 1) t ON t.id = ids.id""", _PIVOTS))  # fmt: skip
def corpus_betweenness(spark, sf_dir):
    """GR2: betweenness of the corpus graph from 16 pivots."""
    e = cut(demo.relation(spark, sf_dir, "sp").select(F.lit("corpus").alias("session"), F.col("from").alias("a"), F.col("to").alias("b")).distinct())
    ids = e.select("session", F.explode(F.array("a", "b")).alias("id")).distinct()
    return reach.pivot_betweenness(ids, e, 16).select("id", F.round("betweenness", 8).alias("betweenness"))


def _distances(most: int = 16) -> str:
    """SQL of p1, p2, ...: numbers k of shortest paths of that length from s to t, and of w, all of them."""
    out = ["p0 AS (SELECT session, id AS s, id AS t, CAST(1 AS DOUBLE) AS k FROM n)"]
    for d in range(1, most + 1):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM p{i} x WHERE x.session = q.session AND x.s = q.s AND x.t = q.t)" for i in range(max(0, d - 2), d))
        out.append(f"p{d} AS (SELECT * FROM (SELECT p.session, s, b AS t, sum(k) AS k FROM p{d - 1} p JOIN uu ON uu.session = p.session AND a = t GROUP BY 1, 2, 3) q WHERE {seen})")
    return ",\n".join([*out, "w AS (" + " UNION ALL ".join(f"SELECT session, s, t, k, {d} AS d FROM p{d}" for d in range(1, most + 1)) + ")"])


_BETWEEN = demo.BASE + f""", uu AS (SELECT DISTINCT session, "from" AS a, "to" AS b FROM g UNION SELECT session, "to", "from" FROM g), {_distances()},
bt AS (SELECT x.session, x.t AS id, sum(x.k * y.k / z.k) AS total FROM w x JOIN w y ON y.session = x.session AND y.s = x.t JOIN w z ON z.session = x.session AND z.s = x.s AND z.t = y.t AND z.d = x.d + y.d GROUP BY 1, 2)"""


@query(demo.duckdb("""SELECT n.session, n.id, round(coalesce(total, 0) / ((c - 1) * (c - 2)), 8) AS betweenness FROM n JOIN (SELECT session, count(*) AS c FROM n GROUP BY 1) m ON m.session = n.session LEFT JOIN bt ON bt.session = n.session AND bt.id = n.id""", _BETWEEN))
def pivot_betweenness_of_all(spark, sf_dir):
    """GR2: exact betweenness of every session, all pivots at once."""
    n, e = demo.nodes(spark, sf_dir), demo.edges(spark, sf_dir)
    return reach.pivot_betweenness(n, graph.valid_edges(n, e).select("session", F.col("from").alias("a"), F.col("to").alias("b"))).select("session", "id", F.round("betweenness", 8).alias("betweenness"))


@query()
def session_communities(spark, sf_dir):
    """GR1: Leiden communities per session (unit-tested)."""
    return community.communities(demo.nodes(spark, sf_dir), demo.edges(spark, sf_dir))


#: Every size is tried: its shown nodes, and the communities that are left with two hidden ones or more.
_SELECTED = _RANKED + """, lv(level, lo, hi, ratio) AS (VALUES ('overview', 10, 20, 0.35), ('standard', 20, 50, 0.7), ('detailed', 50, 100, 1.0)),
o AS (SELECT session, id, community, total, row_number() OVER (PARTITION BY session ORDER BY cls, CASE WHEN cls = 1 THEN -size ELSE 0 END, CASE WHEN cls = 1 THEN community ELSE '' END, total DESC, id) AS rk, size FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY session, community ORDER BY total DESC, id) = 1 THEN 1 ELSE 2 END AS cls, count(*) OVER (PARTITION BY session, community) AS size FROM r0) x),
t AS (SELECT session, level, hi, n, groups, CASE WHEN n <= lo THEN n ELSE least(hi, n, greatest(lo, CAST(round_even(ratio * n, 0) AS INTEGER))) END AS k0 FROM (SELECT session, count(*) AS n, count(DISTINCT community) AS groups FROM o GROUP BY 1) y, lv),
ks AS (SELECT session, level, hi, groups, k0, unnest(range(least(k0, groups), k0 + 1)) AS k FROM t),
cm AS (SELECT session, community, count(*) AS size, max(total) AS best FROM o GROUP BY 1, 2),
shown AS (SELECT ks.session, level, k, community, count(*) AS m FROM ks JOIN o ON o.session = ks.session AND o.rk <= k GROUP BY ALL),
folded AS (SELECT ks.session, ks.level, ks.k, ks.hi, ks.k0, ks.groups, count(*) FILTER (WHERE cm.size - coalesce(m, 0) >= 2) AS f FROM ks JOIN cm ON cm.session = ks.session LEFT JOIN shown s ON s.session = ks.session AND s.level = ks.level AND s.k = ks.k AND s.community = cm.community GROUP BY ALL),
best AS (SELECT session, level, hi, CASE WHEN k0 <= groups THEN k0 ELSE coalesce(max(k) FILTER (WHERE k + f <= hi), groups) END AS k FROM folded GROUP BY session, level, hi, k0, groups),
over AS (SELECT b.session, b.level, b.k, b.k + f.f - b.hi AS excess FROM best b JOIN folded f USING (session, level, k)),
lone AS (SELECT v.session, v.level, v.excess, s.community, CASE WHEN cm.size > 2 THEN 1 ELSE 0 END AS won, cm.best FROM over v JOIN shown s USING (session, level, k) JOIN cm ON cm.session = v.session AND cm.community = s.community WHERE s.m = 1 AND cm.size >= 2),
gone AS (SELECT session, level, community FROM (SELECT *, coalesce(sum(won) OVER (PARTITION BY session, level ORDER BY best, community ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lone) z WHERE excess > before)"""


_SHOWN = """SELECT v.session, v.level, o.id FROM over v JOIN o ON o.session = v.session AND o.rk <= v.k LEFT JOIN gone ON gone.session = v.session AND gone.level = v.level AND gone.community = o.community WHERE gone.session IS NULL"""
_SELECTED_DENSE = demo.BASE + re.sub(r"\bnw\b", "n", _SELECTED.removeprefix(demo.BASE).replace("FROM sp", "FROM g"))


@query(demo.duckdb(_SHOWN, _SELECTED_DENSE))
def level_selection(spark, sf_dir):
    """T4: the nodes of every level after shrinking to its band."""
    return levels.select_nodes(_ranked(spark, sf_dir, False))


@query(demo.duckdb(_SHOWN, _SELECTED))
def level_selection_wide(spark, sf_dir):
    """T4: the same over the wide graph, whose many communities leave more aggregates than a level holds."""
    return levels.select_nodes(_ranked(spark, sf_dir))
