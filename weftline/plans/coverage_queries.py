"""Functions and operators of repair, evidence, layers, evaluation and retrieval over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import relations, text
from ..operators import corpus, editlog, evaluate, gaps, graph, layers, levels, repair
from ..session import table
from ..sources import files
from . import demo
from .registry import query

SPAN = "array<struct<document_id:string,char_start:int,char_end:int,surface:string>>"


def _spans(*surfaces, document="d"):
    doc = F.lit(document) if isinstance(document, str) else document
    return F.array(*(F.struct(doc.alias("document_id"), F.lit(0).alias("char_start"), F.lit(1).alias("char_end"), s.alias("surface")) for s in surfaces)).cast(SPAN)


@query("""SELECT c_custkey AS id, lower(trim('  ' || c_name || ' ')) AS label_norm, c_mktsegment || ' ' || c_name AS message FROM customer""")
def normalized_labels(spark, sf_dir):
    """NFKC, trimmed, case-folded labels (full-width letters become plain ones) and messages."""
    c = table(spark, sf_dir, "customer")
    wide = F.translate(F.concat(F.lit("  "), "c_name", F.lit(" ")), "CustomerSp", "\uff23\uff55\uff53\uff54\uff4f\uff4d\uff45\uff52\uff33\uff50")
    return c.select(F.col("c_custkey").alias("id"), text.normalize_label(wide).alias("label_norm"), text.normalize_message(F.concat("c_mktsegment", F.lit("\u3000\t "), "c_name", F.lit(" "))).alias("message"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE least(1.0, greatest(0.0, p_size / 25.0 - 0.5)) END AS confidence FROM part""")
def clamped_confidences(spark, sf_dir):
    """Confidences within 0..1, what is no number dropped."""
    raw = F.when(F.col("p_size") % 5 == 0, "high").otherwise((F.col("p_size") / 25.0 - 0.5).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), repair.clamp_confidence(raw).alias("confidence"))


@query(demo.duckdb("""SELECT DISTINCT session, community_id AS id, community_id AS name FROM nw WHERE NOT (session < '199501' AND community_id IN ('comm_1', 'comm_2', 'comm_3'))"""))
def added_communities(spark, sf_dir):
    """P3d: communities that nodes name and nobody defines."""
    n = demo.nodes(spark, sf_dir, True)
    known = n.where("session < '199501' and community_id in ('comm_1', 'comm_2', 'comm_3')").select("session", F.col("community_id").alias("id")).distinct()
    return repair.undefined_communities(n, known).select("session", "id", "name")


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 4 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS n, CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN 'said ' || s_name WHEN 2 THEN 'a' WHEN 3 THEN s_name END AS surface, CASE s_suppkey % 5 WHEN 0 THEN 1 END AS char_start FROM supplier""")
def repaired_spans(spark, sf_dir):
    """Spans from objects, strings and lists, in either spelling; half-open ranges lose their offsets."""
    s = table(spark, sf_dir, "supplier")
    k, name = F.col("s_suppkey") % 5, F.col("s_name")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"documentId": "d", "charStart": 1, "charEnd": 9, "surface": "'), name, F.lit('"}')))
        .when(k == 1, F.concat(F.lit('"said '), name, F.lit('"')))
        .when(k == 2, F.concat(F.lit('["a", {"surface": "'), name, F.lit('"}, ""]')))
        .when(k == 3, F.concat(F.lit('{"document_id": "d", "char_start": 7, "surface": "'), name, F.lit('"}')))
        .otherwise("17")
    )
    out = s.select(F.col("s_suppkey").alias("id"), repair.evidence_spans(raw).alias("s"))
    return out.select("id", F.size("s").alias("n"), F.get("s", F.lit(0))["surface"].alias("surface"), F.get("s", F.lit(0))["char_start"].alias("char_start"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 2 THEN '' WHEN s_suppkey % 3 = 1 THEN s_name || ',x' ELSE s_name END AS refs FROM supplier""")
def repaired_refs(spark, sf_dir):
    """P5: references from a string or a list, strings only, once each."""
    k, name = F.col("s_suppkey") % 3, F.col("s_name")
    raw = F.when(k == 0, F.concat(F.lit('"'), name, F.lit('"'))).when(k == 1, F.concat(F.lit('["'), name, F.lit('", 5, "x", null, "'), name, F.lit('"]'))).otherwise("12")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(repair.claim_refs(raw), ",").alias("refs"))


@query("""SELECT c_custkey AS id, concat_ws(' ', c_name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END) AS evidence, concat_ws(' ', ' ' || c_name || ' ', CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END, c_mktsegment) AS full_text FROM customer""")
def evidence_texts(spark, sf_dir):
    """Evidence texts of spans, and what the cue rules read."""
    s = _spans(F.concat(F.lit(" "), "c_name", F.lit(" ")), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")), F.lit(""))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.evidence_text(s).alias("evidence"), text.edge_text(s, F.col("c_mktsegment")).alias("full_text"))


@query("""SELECT p_partkey AS id, contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring') AS correlation_only, CASE WHEN p_size % 3 = 0 THEN '関連' ELSE p_name END AS label FROM part""")
def weak_relations(spark, sf_dir):
    """Texts that only correlate, and labels without their causal mark."""
    label = F.when(F.col("p_size") % 3 == 0, F.lit("⇒ ")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("⚡  "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.only_correlation(F.col("p_name"), ["red", "ring"]).alias("correlation_only"), text.demoted_label(label).alias("label"))


@query(demo.duckdb("""SELECT session, id, CASE WHEN quantity = 50 THEN true WHEN quantity % 2 = 0 THEN confidence >= 0.75 ELSE quantity % 3 = 0 AND quantity % 5 <> 0 END AS backed FROM g"""))
def corroborated_edges(spark, sf_dir):
    """A user's word, else the validation score, else a causal check without demotion."""
    q = F.col("quantity")
    backed = relations.corroborated(F.when(q == 50, "allow"), F.when(q % 2 == 0, F.col("confidence") - 0.20 + 0.20), q % 3 == 0, F.when(q % 5 == 0, "arrow"))
    return demo.edges(spark, sf_dir).select("session", "id", backed.alias("backed"))


@query(demo.duckdb("""SELECT session, id, round(0.5 + (confidence - 0.5) * least(1.0, greatest(0.0, tax * 20 - 0.1)), 6) AS score FROM g"""))
def blended_scores(spark, sf_dir):
    """Base scores drawn towards one half by missing confidence."""
    return demo.edges(spark, sf_dir).select("session", "id", F.round(relations.blend(F.col("confidence"), F.col("tax") * 20 - 0.1), 6).alias("score"))


@query(demo.duckdb("""SELECT session, id FROM g WHERE quantity <> 50 AND (glyph = 'arrow' OR (glyph = 'wave' AND quantity % 2 = 0))"""))
def causal_candidates(spark, sf_dir):
    """causal edges, and correlations demoted from causal, that are not users' own."""
    e = demo.edges(spark, sf_dir).withColumns({"origin": F.when(F.col("quantity") == 50, "user_added"), "causal_check": F.struct(F.when(F.col("quantity") % 2 == 0, "arrow").alias("demoted_from"))})
    return relations.causal_candidates(e).select("session", "id")


@query("""SELECT p_partkey AS id, length(p_name) >= 8 AS inside, length(p_name) >= 8 AND contains(p_type || ' of the ' || p_name, p_name) AS within, p_name = p_type AS same FROM part""")
def contained_texts(spark, sf_dir):
    """equal texts, or one within the other and both of eight characters."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.contained(name, F.concat(name, F.lit("!"))).alias("inside"), text.contained(F.concat("p_type", F.lit(" of the "), name), name).alias("within"), text.contained(name, F.col("p_type")).alias("same"),
    )


@query("""SELECT session, level, violation FROM (SELECT session, level, CASE WHEN s > hi AND s - pinned <= hi THEN 'user_pinned_overflow' WHEN s > hi THEN 'over' WHEN s < lo AND total >= lo THEN 'under' END AS violation FROM (
    SELECT p_partkey AS session, level, lo, hi, p_size + p_size % 7 AS s, p_size % 9 AS pinned, p_size + 5 AS total FROM part, (VALUES ('overview', 10, 20), ('standard', 20, 50), ('detailed', 50, 100)) l(level, lo, hi)) x) y WHERE violation IS NOT NULL""")
def band_violations(spark, sf_dir):
    """levels outside their band; an overflow that pins explain is named so."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("session"), F.explode(F.array(*map(F.lit, ("overview", "standard", "detailed")))).alias("level"), F.col("p_size").alias("nodes"), (F.col("p_size") % 7).alias("aggregates"),
        (F.col("p_size") % 9).alias("pinned"), (F.col("p_size") + 5).alias("total"),
    )
    return levels.check_bands(p).select("session", "level", "violation")


@query(demo.duckdb("""SELECT sp.session, sp.id, sp."from" AS from_label, lower(b.label) AS to_norm FROM sp JOIN labels_wide b ON b.label = sp."to" WHERE sp."from" IN (SELECT label FROM labels_wide) AND b.community_id <> 'comm_7'"""))
def labelled_edges(spark, sf_dir):
    """Edges with the labels of both ends; those without an existing end are dropped."""
    n = demo.nodes(spark, sf_dir, True).where("label not like 'Supplier%' or community_id <> 'comm_7'")
    return corpus.labelled_edges(n, demo.edges(spark, sf_dir, True), text.ascii_norm).select("session", "id", "from_label", "to_norm")


@query("""SELECT session, label, id FROM (SELECT n_regionkey AS session, n_name AS label, 'c' || lpad(CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS VARCHAR(9)), 3, '0') AS id FROM nation
    UNION ALL SELECT session, label, 'c' || lpad(CAST(k - 1 + row_number() OVER (PARTITION BY session ORDER BY pos) AS VARCHAR(9)), 3, '0') FROM (SELECT n_regionkey AS session, 'brand ' || p_size AS label, min(p_partkey) AS pos, any_value(k) AS k
        FROM part JOIN (SELECT n_nationkey, n_regionkey, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation) n ON p_partkey % 25 = n_nationkey GROUP BY 1, 2) f) u WHERE CAST(substr(id, 2) AS INTEGER) < 30""")
def merged_fragments(spark, sf_dir):
    """Fragments merged by label; new nodes get free ids in order of arrival, up to a number."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    known = n.select(F.col("n_regionkey").cast("string").alias("session"), F.concat(F.lit("c"), F.lpad((F.row_number().over(w) - 1).cast("string"), 3, "0")).alias("id"), F.col("n_name").alias("label"), F.lit("x").alias("community_id"))
    p = table(spark, sf_dir, "part").join(n, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    frag = p.select(F.col("n_regionkey").cast("string").alias("session"), F.concat(F.lit("f"), "p_partkey").alias("id"), F.concat(F.lit("brand "), "p_size").alias("label"), F.lit("y").alias("community_id"), F.col("p_partkey").alias("pos"))
    frag = frag.unionByName(n.select(F.col("n_regionkey").cast("string").alias("session"), F.concat(F.lit("g"), "n_nationkey").alias("id"), F.lower("n_name").alias("label"), F.lit("z").alias("community_id"), F.lit(0).alias("pos")))
    none = spark.createDataFrame([], f"session string, id string, `from` string, `to` string, glyph string, label string, confidence double, evidence_span {SPAN}")
    nodes, _, _ = repair.merge_fragment(known, none, frag, none, 30, text.ascii_norm)
    return nodes.select(F.col("session").cast("int").alias("session"), "label", "id")


@query("""SELECT session, text, zone_label FROM (SELECT x.p_brand AS session, x.p_name AS text, arg_min(z.p_type, CASE WHEN z.t = x.p_name THEN 0 ELSE 10000000 END + z.p_partkey) AS zone_label
    FROM (SELECT DISTINCT p_brand, p_name FROM part) x JOIN (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'the ' || p_name || ' in full' END AS t FROM part) z
    ON z.p_brand = x.p_brand AND (z.t = x.p_name OR (least(length(z.t), length(x.p_name)) >= 8 AND (contains(z.t, x.p_name) OR contains(x.p_name, z.t)))) GROUP BY 1, 2) y""")
def zones_of_texts(spark, sf_dir):
    """The zone of a text by its own sentence, else by the first that contains it or is contained."""
    p = table(spark, sf_dir, "part")
    t = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("the "), "p_name", F.lit(" in full")))
    z = p.select(F.col("p_brand").alias("session"), t.alias("text"), F.col("p_type").alias("zone_label"), F.col("p_partkey").alias("pos"))
    return layers.zone_of_text(p.select(F.col("p_brand").alias("session"), F.col("p_name").alias("text")).distinct(), z, ["session"])


@query(demo.duckdb("""SELECT sp.session, sp.id, concat_ws(',', CASE WHEN glyph = 'isa' OR o.a THEN 'is_a' END, CASE WHEN o.p THEN 'part_of' END) AS layer_a FROM sp LEFT JOIN (
    SELECT session, "from" AS f, "to" AS t, bool_or(quantity >= 40) AS a, bool_or(quantity <= 10) AS p FROM sp WHERE quantity >= 40 OR quantity <= 10 GROUP BY 1, 2, 3) o ON o.session = sp.session AND o.f = sp."from" AND o.t = sp."to" """))
def ontology_tags(spark, sf_dir):
    """is_a and part_of of the ontology on edges between the same labels in the same direction."""
    e = demo.edges(spark, sf_dir, True).withColumnsRenamed({"from": "from_norm", "to": "to_norm"}).withColumn("layer_tags", layers.first_tags(F.col("glyph")))
    o = e.where("quantity >= 40").select("session", "from_norm", "to_norm", F.lit("is_a").alias("relation")).unionByName(e.where("quantity <= 10").select("session", "from_norm", "to_norm", F.lit("part_of").alias("relation")))
    return layers.add_ontology_tags(e, o).select("session", "id", F.array_join("layer_tags.layer_A", ",").alias("layer_a"))


@query("""SELECT n_regionkey AS session, n_name AS id, string_agg(DISTINCT CAST(s_suppkey AS VARCHAR(9)), ',' ORDER BY CAST(s_suppkey AS VARCHAR(9))) AS refs FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def claims_of_nodes(spark, sf_dir):
    """Claims on the nodes whose label they name."""
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_regionkey").alias("session"), F.col("n_name").alias("id"), F.col("n_name").alias("label"))
    claims = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("session"), F.col("s_suppkey").cast("string").alias("claim_id"), F.array(F.concat(F.lit(" "), F.lower("n_name")), F.lit("nobody")).alias("concepts"))
    return layers.claims_of_nodes(claims, nodes).select("session", "id", F.array_join("claim_refs", ",").alias("refs"))


@query("""WITH c AS (SELECT p_brand AS session, p_partkey AS claim, CASE WHEN p_size % 2 = 1 THEN p_name || ' again' ELSE p_name END AS t FROM part)
    SELECT p_brand AS session, p_partkey AS id, count(DISTINCT claim) AS refs FROM part JOIN c ON session = p_brand AND (t = p_name OR (least(length(t), length(p_name)) >= 8 AND (contains(t, p_name) OR contains(p_name, t)))) GROUP BY 1, 2""")
def claims_of_edges(spark, sf_dir):
    """Claims on the edges whose evidence is their sentence, or contains it or is contained."""
    p = table(spark, sf_dir, "part")
    e = p.select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("id"), _spans(F.col("p_name")).alias("evidence_span"))
    c = p.select(F.col("p_brand").alias("session"), F.col("p_partkey").cast("string").alias("claim_id"), F.when(F.col("p_size") % 2 == 1, F.concat("p_name", F.lit(" again"))).otherwise(F.col("p_name")).alias("sentence"))
    return layers.claims_of_edges(c, e).select("session", "id", F.size("claim_refs").cast("long").alias("refs"))


@query(demo.duckdb("""SELECT DISTINCT sp.session, sp.id, a, b FROM sp JOIN (SELECT session, id AS a, id || 'x' AS b, "from" AS f, "to" AS t FROM sp WHERE quantity = 7) p ON p.session = sp.session AND ((sp."from" = p.f AND sp."to" = p.t) OR sp.id = p.a)"""))
def refute_targets(spark, sf_dir):
    """The edges that a refuted pair of claims is about."""
    g = demo.edges(spark, sf_dir, True)
    e = g.select("session", "id", F.when(F.col("quantity") == 7, F.array("id", F.concat("id", F.lit("x")))).otherwise(F.array(F.lit("-"))).alias("claim_refs"), F.col("from").alias("from_norm"), F.col("to").alias("to_norm"))
    both = F.array("from", "to")
    pairs = g.where("quantity = 7").select("session", F.col("id").alias("a"), F.concat("id", F.lit("x")).alias("b"), both.alias("concepts_a"), both.alias("concepts_b"))
    return layers.refute_targets(e, pairs).select("session", "id", "a", "b")


#: Judgements of which a fifth have the edge's id, others its labels in this or another session, or labels of nothing.
_JUDGED = """, lab AS (SELECT CASE WHEN quantity % 3 = 1 THEN 'elsewhere' ELSE session END AS session, CASE WHEN quantity % 5 = 0 THEN id ELSE 'old-' || id END AS edge_id, CASE WHEN quantity % 7 = 0 THEN 'nobody' ELSE "from" END AS f, "to" AS t,
    CASE WHEN quantity % 2 = 0 THEN 'correct' ELSE 'incorrect' END AS verdict, confidence > 0.95 AS causal_ok, session || id AS ts, tax FROM sp WHERE quantity >= 35),
own AS (SELECT session, "from" AS f, "to" AS t, min(id) AS id FROM sp GROUP BY 1, 2, 3), newest AS (SELECT f, t, max(session) AS session, arg_max(id, session) AS id FROM own GROUP BY 1, 2),
m0 AS (SELECT lab.*, coalesce(e.session, own.session, newest.session) AS ms, coalesce(e.id, own.id, newest.id) AS mi FROM lab LEFT JOIN sp e ON e.session = lab.session AND e.id = lab.edge_id
    LEFT JOIN own ON own.session = lab.session AND own.f = lab.f AND own.t = lab.t LEFT JOIN newest ON newest.f = lab.f AND newest.t = lab.t),
m1 AS (SELECT m0.*, e.glyph, CASE WHEN mi IS NULL THEN 'missing' WHEN e.quantity = 50 THEN 'user_origin' ELSE 'matched' END AS status, coalesce(ms || '|' || mi, '?' || m0.session || '|' || edge_id || '|' || f || '|' || t) AS ident FROM m0 LEFT JOIN sp e ON e.session = ms AND e.id = mi),
m AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY ident ORDER BY ts DESC) = 1)"""


def _judged(spark, sf_dir):
    e = demo.edges(spark, sf_dir, True, ("glyph", "confidence", "quantity"))
    q = F.col("quantity")
    lab = e.where("quantity >= 35").select(
        F.when(q % 3 == 1, "elsewhere").otherwise(F.col("session")).alias("session"), F.when(q % 5 == 0, F.col("id")).otherwise(F.concat(F.lit("old-"), "id")).alias("edge_id"),
        F.when(q % 7 == 0, "nobody").otherwise(F.col("from")).alias("from_norm"), F.col("to").alias("to_norm"), F.when(q % 2 == 0, "correct").otherwise("incorrect").alias("verdict"),
        (F.col("confidence") > 0.95).alias("causal_ok"), F.concat("session", "id").alias("ts"), F.lit(0).alias("seq"),
    )
    now = e.select("session", F.col("id").alias("edge_id"), F.col("from").alias("from_norm"), F.col("to").alias("to_norm"), "glyph", F.when(q == 50, "user_added").alias("origin"))
    return evaluate.match_labels(lab, now), now


@query(demo.duckdb("""SELECT status, coalesce(ms, session) AS m_session, coalesce(mi, edge_id) AS m_edge_id, verdict, ts FROM m""", demo.BASE + _JUDGED))
def matched_judgements(spark, sf_dir):
    """Judgements on the current graph by id, else by labels in the same session, else in the newest; the later one wins."""
    return _judged(spark, sf_dir)[0].select("status", "m_session", "m_edge_id", "verdict", "ts")


@query(demo.duckdb("""SELECT round(count_if(ok) / count_if(u), 3) AS relation_accuracy, round(count_if(u AND arrow AND causal_ok) / count_if(u AND arrow), 3) AS causal_precision, count_if(u) AS judged_relations, round(count_if(u) / (SELECT count(*) FROM sp), 3) AS coverage,
    round(least(1.0, count(*) / 150), 3) AS gold_progress, count_if(status = 'user_origin') AS user_origin, count_if(status = 'missing') AS missing FROM (SELECT *, status = 'matched' AS u, status = 'matched' AND verdict = 'correct' AS ok, glyph = 'arrow' AS arrow FROM m) x""", demo.BASE + _JUDGED))
def offline_metrics(spark, sf_dir):
    """Accuracy, causal precision, coverage and progress over the matched judgements."""
    m, now = _judged(spark, sf_dir)
    return evaluate.offline_metrics(m, now.count()).select("relation_accuracy", "causal_precision", "judged_relations", "coverage", "gold_progress", "user_origin", "missing")


@query("""SELECT x.p_partkey AS id, concat_ws(',', CASE WHEN x.p_size % 2 = 0 THEN 'a' || x.p_size END, CASE WHEN x.p_size % 3 <> 0 THEN 'b' || x.p_size END) AS refs FROM part x""")
def rejected_refs(spark, sf_dir):
    """References to rejected claims removed."""
    p = table(spark, sf_dir, "part")
    e = p.select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("a"), "p_size"), F.concat(F.lit("b"), "p_size")).alias("claim_refs"))
    gone = p.select(F.col("p_brand").alias("session"), F.explode(F.array_compact(F.array(F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("a"), "p_size")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("b"), "p_size"))))).alias("claim_id"))
    return layers.drop_rejected_refs(e, gone).select("id", F.array_join("claim_refs", ",").alias("refs"))


@query("""SELECT gap_id, session, CASE WHEN l AND r THEN 'both' WHEN l THEN 'left' ELSE 'right' END AS side FROM (SELECT event_id % 50 AS gap_id, user_id AS session, bool_or(value < 20) AS l, bool_or(value >= 20) AS r FROM events GROUP BY 1, 2) x""")
def session_sides(spark, sf_dir):
    """Sessions that mention both sides of a gap, or one."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("gap_id"), F.col("user_id").alias("session"), F.when(F.col("value") < 20, "left").otherwise("right").alias("side"))
    return gaps.both_sides(e)


@query(demo.duckdb("""SELECT DISTINCT nw.session, nw.id AS node_id, s.surface FROM nw LEFT JOIN (SELECT session, id, surface FROM (SELECT session, "to" AS id, brand AS surface FROM sp WHERE quantity >= 25 UNION ALL SELECT session, "from", brand FROM sp WHERE quantity >= 25) x) s USING (session, id) WHERE nw.community_id IN ('comm_3', 'comm_4')"""))
def label_mentions(spark, sf_dir):
    """Where concepts are mentioned, in the spans of their edges, else the concept alone."""
    n = demo.nodes(spark, sf_dir, True).withColumn("evidence_span", F.array().cast(SPAN))
    e = demo.edges(spark, sf_dir, True).withColumn("evidence_span", F.when(F.col("quantity") >= 25, _spans(F.col("brand"))))
    return gaps.mentions(n.where("community_id in ('comm_3', 'comm_4')").select("label"), n, e).select("session", "node_id", "surface")


@query(demo.duckdb("""SELECT g.session, g.id, CASE WHEN o.d = 'reverse' THEN "to" ELSE "from" END AS "from", CASE WHEN o.d = 'reverse' THEN "from" ELSE "to" END AS "to", CASE WHEN o.d IN ('allow', 'reverse') THEN 'allow' ELSE o.d END AS causal_override
    FROM g LEFT JOIN (VALUES ('machinery', 'nation_3', 'deny'), ('renamed', 'nation_4', 'reverse'), ('building', 'nation_5', 'allow')) o(f, t, d) ON o.f = CASE WHEN "from" = 'AUTOMOBILE' THEN 'renamed' ELSE lower("from") END AND o.t = lower("to") WHERE "to" <> 'NATION_2'"""))
def applied_learning(spark, sf_dir):
    """Learned names, stop-list and causal decisions applied to a graph."""
    ren = spark.createDataFrame([("automobile", "RENAMED", True), ("furniture", "NOT AUTO", False)], "from_norm string, to_label string, auto boolean")
    stop = spark.createDataFrame([("nation_2", True), ("nation_6", False)], "label_norm string, auto boolean")
    over = spark.createDataFrame([("machinery", "nation_3", "deny"), ("renamed", "nation_4", "reverse"), ("building", "nation_5", "allow")], "from_norm string, to_norm string, decision string")
    e = demo.edges(spark, sf_dir).withColumn("causal_override", F.lit(None).cast("string"))
    return editlog.apply_learned(demo.nodes(spark, sf_dir), e, ren, stop, over)[1].select("session", "id", "from", "to", "causal_override")


@query("""SELECT cue, CAST(count_if(NOT down) AS BIGINT) AS kept, CAST(count_if(down) AS BIGINT) AS downgraded_by_user FROM (SELECT p_name AS cue, p_size % 2 = 0 AS down FROM part) x GROUP BY 1 HAVING count_if(down) >= 3 AND count_if(down) / count(*) >= 0.5""")
def cue_warnings(spark, sf_dir):
    """Cues that users took back too often."""
    c = table(spark, sf_dir, "part").select(F.col("p_name").alias("cue"), "p_size")
    return editlog.cue_warnings(editlog.cue_stats(c.where("p_size % 2 = 1"), c.where("p_size % 2 = 0"))).select("cue", "kept", "downgraded_by_user")


@query("""SELECT user_id AS session, count(*) AS zones, count_if(event_type = 'click') AS claims, count_if(event_type = 'click' AND value > 50) AS validated, count_if(event_type = 'view') AS arguments, count_if(event_type = 'purchase' AND value > 20) AS refutes FROM events GROUP BY 1""")
def sidecar_stats(spark, sf_dir):
    """Counts of a side-car per session."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_type", "value")
    claims = e.where("event_type = 'click'").withColumn("status", F.when(F.col("value") > 50, "validated"))
    refutes = e.where("event_type = 'purchase'").withColumn("verdict", F.when(F.col("value") > 20, "refutes").otherwise("none"))
    return files.sidecar_stats(e, claims, e.where("event_type = 'view'"), refutes)


@query("""SELECT p_name AS document_id, min(p_partkey) AS pos FROM part GROUP BY 1""")
def first_documents(spark, sf_dir):
    """Document ids in the order in which they first occur."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("document_id"), F.col("p_partkey").alias("pos"))
    return files.document_ids(p.unionByName(p.select(F.lit("").alias("document_id"), "pos")))


@query(demo.duckdb("""SELECT session, id, min(brand) AS document_id FROM (SELECT session, "from" AS id, brand FROM sp UNION ALL SELECT session, "to", brand FROM sp) x GROUP BY 1, 2 HAVING count(DISTINCT brand) = 1"""))
def documents_of_nodes(spark, sf_dir):
    """The document of a node if its edges name one only."""
    e = demo.edges(spark, sf_dir, True).withColumn("evidence_span", _spans(F.lit("x"), document=F.col("brand")))
    return corpus.node_documents(e)


@query("""WITH RECURSIVE r AS (SELECT 'n' || s_suppkey AS c, 'n' || s_nationkey AS p FROM supplier), w AS (SELECT c, p FROM r UNION SELECT w.c, r.p FROM w JOIN r ON w.p = r.c), cyc AS (SELECT DISTINCT c FROM w WHERE c = p),
    e AS (SELECT s_suppkey AS id, 'n' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'is_a' AS relation FROM supplier UNION ALL SELECT 100000 + s_suppkey, 'n' || s_suppkey, 'n' || (s_suppkey + 1), 'causes' FROM supplier),
    sib AS (SELECT DISTINCT x.c AS a, y.c AS b FROM r x JOIN r y ON x.p = y.p AND x.c <> y.c)
    SELECT id, CAST(CASE WHEN (relation = 'is_a' AND src IN (SELECT c FROM cyc) AND dst IN (SELECT c FROM cyc)) OR CAST(substr(src, 2) AS INTEGER) % 10 = 3 AND dst = (SELECT p FROM r WHERE r.c = src) THEN 0.0 WHEN relation = 'causes' AND (src, dst) IN (SELECT a, b FROM sib) THEN 0.5 ELSE 1.0 END AS DOUBLE) AS score FROM e""")
def ontology_scores(spark, sf_dir):
    """GR6: 0 on a cycle or with two kinds for a pair, one half for a cause between siblings, else 1."""
    s = table(spark, sf_dir, "supplier")
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    key, nat = F.col("s_suppkey"), F.col("s_nationkey")
    isa = s.select(F.lit("s").alias("session"), n(key).alias("src"), n(nat).alias("dst"), F.lit("is_a").alias("relation"))
    onto = isa.unionByName(s.where("s_suppkey % 10 = 3").select(F.lit("s").alias("session"), n(key).alias("src"), n(nat).alias("dst"), F.lit("part_of").alias("relation")))
    e = s.select(F.lit("s").alias("session"), key.alias("id"), n(key).alias("src"), n(nat).alias("dst"), F.lit("is_a").alias("relation"))
    e = e.unionByName(s.select(F.lit("s").alias("session"), (key + 100000).alias("id"), n(key).alias("src"), n(key + 1).alias("dst"), F.lit("causes").alias("relation")))
    return graph.ontology_scores(e, onto).select("id", F.col("ontology_score").alias("score"))


def _tagged(spark, sf_dir):
    e = demo.edges(spark, sf_dir, True)
    q = F.col("quantity")
    none = F.array().cast("array<string>")
    tags = F.struct(none.alias("layer_A"), F.when(q > 45, F.array(F.lit("method_of"))).otherwise(none).alias("layer_B"), F.when(q % 2 == 0, F.array(F.lit("causes"))).otherwise(none).alias("layer_C"), none.alias("layer_D"))
    val = F.struct(F.when(q % 3 == 0, "rejected").when(q % 3 == 1, "uncertain").alias("status"), F.lit(0.5).alias("combined"))
    return e.withColumns({"layer_tags": tags, "validation": val, "causal_check": F.struct(F.when(q % 4 == 0, "arrow").alias("demoted_from"))})


@query(demo.duckdb("""SELECT nw.session, 'gap-discourse-' || nw.id AS gap_id, 'claim_refs=1, layer_B:method_of=0/' || count(x.id) AS signal FROM nw LEFT JOIN (SELECT session, "from" AS id, quantity FROM sp UNION ALL SELECT session, "to", quantity FROM sp) x USING (session, id)
    WHERE nw.community_id < 'comm_2' GROUP BY nw.session, nw.id HAVING coalesce(max(x.quantity), 0) <= 45"""))
def discourse_gaps(spark, sf_dir):
    """GR8: nodes with claims of which no edge tells the method."""
    n = demo.nodes(spark, sf_dir, True).withColumn("claim_refs", F.when(F.col("community_id") < "comm_2", F.array(F.lit("k"), F.lit(""))))
    return gaps.discourse(n, _tagged(spark, sf_dir)).select("session", "gap_id", "signal")


@query(demo.duckdb("""SELECT session, 'gap-causal-' || id AS gap_id, CAST(CASE quantity % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.5 ELSE 0.45 END AS DOUBLE) AS confidence, CASE WHEN quantity % 3 = 0 THEN 'true' ELSE 'unknown' END AS presumed_type
    FROM sp WHERE quantity % 2 = 0 AND glyph <> 'arrow' AND (quantity % 3 < 2 OR quantity % 4 = 0)"""))
def causal_gaps(spark, sf_dir):
    """GR9: causes that are not shown as such: refused, uncertain or demoted."""
    return gaps.causal(demo.nodes(spark, sf_dir, True), _tagged(spark, sf_dir)).select("session", "gap_id", "confidence", "presumed_type")


@query("""SELECT session, 'gap-declared-' || c AS gap_id, members FROM (SELECT p_brand AS session, p_type AS c, string_agg(CAST(p_partkey AS VARCHAR(9)), ',' ORDER BY CAST(p_partkey AS VARCHAR(9))) AS members FROM part GROUP BY 1, 2) x WHERE c < 'M'""")
def declared_gaps(spark, sf_dir):
    """GR10: communities that the extraction itself marks as gaps."""
    n = table(spark, sf_dir, "part").select(F.col("p_brand").alias("session"), F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("community_id"))
    c = n.select("session", F.col("community_id").alias("id"), (F.col("community_id") < "M").alias("is_gap")).distinct()
    return gaps.declared(n, c).select("session", "gap_id", F.array_join("related_node_ids", ",").alias("members"))


@query("""SELECT user_id AS session, 'x' || (event_id % 17) AS edge_id, 'incorrect' AS verdict FROM events WHERE event_type = 'purchase' OR (event_type NOT IN ('signup', 'click', 'purchase', 'error') AND event_id % 2 = 1)""")
def judged_by_edits(spark, sf_dir):
    """Verdicts that deleting and retyping edges imply."""
    return editlog.evaluation_of_edits(demo.edits(spark, sf_dir)).select(F.col("session").cast("long").alias("session"), "edge_id", "verdict")


@query("""SELECT o_orderkey AS id FROM orders WHERE floor((epoch(TIMESTAMP '1998-01-01 00:00:00') - epoch(CAST(o_orderdate AS TIMESTAMP))) / 60) <= 100000""")
def pruned_cache(spark, sf_dir):
    """Cache entries within their time to live."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created"))
    return files.prune(c, F.lit("1998-01-01 00:00:00").cast("timestamp"), 100_000).select("id")


@query("""SELECT session, community, count(*) AS hidden FROM (SELECT p_brand AS session, p_type AS community, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) x WHERE r > 10 GROUP BY 1, 2 HAVING count(*) >= 2""")
def hidden_communities(spark, sf_dir):
    """T5: communities with hidden members enough for an aggregate."""
    from pyspark.sql import Window

    r = table(spark, sf_dir, "part").select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("id"), F.col("p_type").alias("community"), "p_size")
    top = r.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("p_size"), "id"))).where("r <= 10")
    return levels.hidden_communities(r, top)


@query("""SELECT question, session, id FROM (SELECT user_id AS question, event_type AS session, event_id % 20 AS id, min(event_id % 6) AS tp, arg_min(event_id, (event_id % 6) * 10000000 + event_id) AS rk FROM events WHERE value < 60 GROUP BY 1, 2, 3) x
    QUALIFY row_number() OVER (PARTITION BY question ORDER BY tp, rk, session, id) <= 8""")
def question_seeds(spark, sf_dir):
    """Node hits in order of terms, once each, eight of a question."""
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("session"), (F.col("event_id") % 20).alias("id"), (F.col("event_id") % 6).alias("term_pos"), F.col("event_id").alias("rank"), F.when(F.col("value") < 60, "node").otherwise("edge").alias("kind"))
    return corpus.seeds(h).select("question", "session", "id")


@query(demo.duckdb("""SELECT session, id, rank, CASE WHEN rank <= 16 AND c >= 0.75 THEN 'validated' WHEN rank > 16 OR c >= 0.5 THEN 'uncertain' ELSE 'rejected' END AS status FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY kind, pos, id) AS INTEGER) AS rank FROM (
    SELECT session, 1 AS kind, id, 0 AS pos, quantity / 50 AS c FROM g WHERE glyph = 'arrow' UNION ALL SELECT session, 0, 'k' || id, CAST(substr(id, 2) AS INTEGER), quantity / 50 FROM g WHERE quantity = 50 OR quantity = 20) q) r WHERE rank <= 60"""))
def validation_queue(spark, sf_dir):
    """What to validate, claims first, sixty of a session; the verifiers answer the first sixteen."""
    e = demo.edges(spark, sf_dir).withColumns({"origin": F.lit(None).cast("string"), "causal_check": F.struct(F.lit(None).cast("string").alias("demoted_from"))})
    claims = e.where("quantity = 50 or quantity = 20").select("session", F.concat(F.lit("k"), "id").alias("claim_id"), F.substring("id", 2, 9).cast("int").alias("pos"))
    q = layers.validation_queue(claims, e)
    score = e.select("session", "id", (F.col("quantity") / 50).alias("score"))
    q = q.join(score.unionByName(score.withColumn("id", F.concat(F.lit("k"), "id"))), ["session", "id"])
    return layers.validate(q, nli=F.col("score")).select("session", "id", "rank", F.col("validation.status").alias("status"))


@query("""SELECT ref, arg_min(kind, p) AS kind FROM (SELECT n_name AS ref, 'local' AS kind, 0 AS p FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_name, 'global', 1 FROM nation WHERE n_regionkey > 1 UNION ALL SELECT r_name, 'more', 2 FROM region) x GROUP BY 1""")
def merged_material(spark, sf_dir):
    """Material of several sources, the first of equal references wins."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    part = lambda df, c, kind: df.select(F.col(c).alias("ref"), F.lit(kind).alias("kind"), F.lit("t").alias("text"))
    return corpus.merge_material(part(n.where("n_regionkey < 3"), "n_name", "local"), part(n.where("n_regionkey > 1"), "n_name", "global"), part(r, "r_name", "more")).select("ref", "kind")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 2 ELSE 3 END AS n FROM part""")
def merged_spans(spark, sf_dir):
    """Spans united by document, surface and place."""
    k = F.col("p_size") % 3
    a = _spans(F.col("p_name"))
    b = F.when(k == 0, a).when(k == 1, _spans(F.col("p_name"), F.col("p_type"))).otherwise(_spans(F.lit("x"), F.lit("y"), F.col("p_name")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.size(repair.merge_spans(a, b)).alias("n"))


@query(demo.duckdb("""SELECT (SELECT count(*) FROM nw) AS node_rows, (SELECT count(DISTINCT lower(label)) FROM nw) AS labels, (SELECT count(DISTINCT session) FROM nw) AS sessions, (SELECT count(*) FROM sp) AS edge_rows"""))
def index_stats(spark, sf_dir):
    """Counts of an index."""
    n = demo.nodes(spark, sf_dir, True).withColumn("label_norm", text.ascii_norm(F.col("label")))
    return files.index_stats(n, demo.edges(spark, sf_dir, True))


@query("""SELECT s_suppkey % 4 AS how, count(*) AS n, count_if(ok) AS found FROM (SELECT s_suppkey, s_suppkey % 4 <> 3 AS ok FROM supplier) x GROUP BY 1""")
def resolved_documents(spark, sf_dir):
    """Documents by exact name, base name, stem, or the only name that contains the id."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 4
    names = s.select(F.concat(F.lit("docs/"), "s_name", F.lit(".pdf")).alias("name"))
    ids = s.select(k.alias("how"), F.when(k == 0, F.concat(F.lit("docs/"), "s_name", F.lit(".pdf"))).when(k == 1, F.concat(F.lit("other/"), F.upper("s_name"), F.lit(".PDF"))).when(k == 2, F.col("s_name")).otherwise(F.concat("s_name", F.lit("?"))).alias("document_id"))
    out = ids.join(files.resolve_documents(ids, names), "document_id")
    return out.groupBy("how").agg(F.count("*").alias("n"), F.count("name").alias("found"))


@query("""SELECT question, string_agg(DISTINCT line, chr(10) ORDER BY line) AS answer FROM (SELECT c_nationkey AS question, '- ' || c_mktsegment || ' → ' || 'x' || (c_custkey % 3) || ' (wave)' AS line FROM customer) x GROUP BY 1""")
def offline_answers(spark, sf_dir):
    """Answers without a language model, the relations listed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("question"), F.col("c_mktsegment").alias("from_label"), F.concat(F.lit("x"), F.col("c_custkey") % 3).alias("to_label"), F.lit("wave").alias("glyph"))
    return corpus.offline_answer(c)


@query("""SELECT user_id AS session, event_id AS id FROM events WHERE value > 50 AND event_type = 'click'""")
def validated_claims(spark, sf_dir):
    """F8: claims that the verifiers confirmed."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.struct(F.when(F.col("value") > 50, "validated").otherwise("uncertain").alias("status")).alias("validation"))
    return layers.validated_claims(e).select("session", "id")


@query("""SELECT c_custkey AS id, CASE WHEN w <= 12 THEN 1 ELSE 2 END AS lines, round(CASE WHEN w <= 12 THEN w ELSE w / 2 END, 6) AS width, CASE WHEN w <= 10 THEN t ELSE left(t, CAST(floor((10 - 0.6) / 0.55 + 0.000001) AS INTEGER)) || '…' END AS cut FROM (SELECT c_custkey, t, length(t) * 0.55 AS w FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || c_mktsegment END AS t FROM customer) x) y""")
def display_lines(spark, sf_dir):
    """Balanced lines and texts cut to a width."""
    c = table(spark, sf_dir, "customer")
    t = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", "c_mktsegment"))
    b = text.balanced_lines(t)
    return c.select(F.col("c_custkey").alias("id"), b["lines"].alias("lines"), F.round(b["width"], 6).alias("width"), text.truncate(t, 10.0).alias("cut"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '[1, {"a": 2}]' WHEN 1 THEN '{"n": "' || s_name || '"}' WHEN 2 THEN '[' || s_suppkey || ']' END AS json FROM supplier""")
def json_in_prose(spark, sf_dir):
    """The whole text if it is JSON, else the first object, else the first array."""
    k = F.col("s_suppkey") % 4
    t = F.when(k == 0, ' [1, {"a": 2}] ').when(k == 1, F.concat(F.lit('done [1] {x {"n": "'), "s_name", F.lit('"} ok'))).when(k == 2, F.concat(F.lit("see {no} ["), "s_suppkey", F.lit("] end"))).otherwise("none [here}")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.extract_json(t).alias("json"))


@query("""WITH x AS (SELECT p_brand AS session, p_partkey AS id, p_size % 6 AS k FROM part), said AS (
    SELECT session, id, 0 AS o, 'd' || (id % 4) AS c FROM x WHERE k = 0 UNION ALL SELECT session, id, 2, 'o' || (id % 4) FROM x WHERE k IN (0, 1) UNION ALL SELECT session, id, 3, 'p' FROM x WHERE k IN (1, 2) UNION ALL SELECT session, id, 4, 'agg' FROM x WHERE k IN (2, 3) UNION ALL SELECT session, id, 5, 'own' FROM x WHERE k = 4)
    SELECT session, id, arg_min(c, o) AS community FROM said WHERE id % 10 <> 0 GROUP BY 1, 2""")
def frozen_map(spark, sf_dir):
    """E5: the communities that a drawn map has fixed, by its levels, itself, its aggregates, and users' own nodes."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("id"), (F.col("p_size") % 6).alias("k"))
    at = lambda ks, level, c: p.where(F.col("k").isin(*ks)).select("session", F.lit(level).cast("string").alias("level"), "id", c.alias("community"))
    shown = at([0], "detailed", F.concat(F.lit("d"), F.col("id") % 4)).unionByName(at([0, 1], "overview", F.concat(F.lit("o"), F.col("id") % 4))).unionByName(at([1, 2], None, F.lit("p")))
    folded = p.where("k in (2, 3)").groupBy("session").agg(F.collect_list("id").alias("members")).withColumns({"community": F.lit("agg"), "pos": F.lit(0)})
    nodes = p.where("id % 10 <> 0").withColumns({"origin": F.when(F.col("k") == 4, "user_added"), "community_id": F.lit("own")})
    return levels.frozen_map(shown, folded, nodes)


@query("""SELECT user_id AS session, min(event_id) AS stop FROM (SELECT user_id, event_id, event_type <> 'click' AS dry, lag(event_type <> 'click') OVER w AS dry1, lag(event_type <> 'click', 2) OVER w AS dry2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) x WHERE dry AND dry1 AND dry2 GROUP BY 1""")
def dry_streaks(spark, sf_dir):
    """Where a search ends that found nothing three times in a row."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("round"), (F.col("event_type") == "click").cast("int").alias("found"))
    return layers.dry_streaks(e, 3)


@query("""SELECT user_id AS session, count_if(event_id % 4 = 0) AS structural, count_if(event_id % 4 = 1) AS discourse, count_if(event_id % 4 > 1) AS causal, count(*) AS total FROM events GROUP BY 1""")
def gap_counts(spark, sf_dir):
    """Gaps by type."""
    k = F.col("event_id") % 4
    return gaps.counts_by_type(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.when(k == 0, "structural").when(k == 1, "discourse").otherwise("causal").alias("gap_type")))


@query("""SELECT user_id AS session, '# Gaps' || chr(10) || chr(10) || string_agg('- **g' || event_id || '** (' || event_type || ', 0.5): s', chr(10) ORDER BY event_id) || chr(10) AS text FROM events GROUP BY 1""")
def gap_report_text(spark, sf_dir):
    """The gap report as Markdown."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.concat(F.lit("g"), "event_id").alias("gap_id"), F.col("event_type").alias("gap_type"), F.lit(0.5).alias("confidence"), F.lit("s").alias("signal"), F.col("event_id").alias("turn"))
    return gaps.report_markdown(e, "Gaps")


@query("""SELECT (SELECT count(DISTINCT p_name) FROM part) AS renames, (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING min(p_size) < 5) x) AS renames_auto, (SELECT count(*) FROM supplier) AS stopped, (SELECT count_if(s_acctbal > 0) FROM supplier) AS stopped_auto,
    count_if(event_type = 'click') AS overrides_allow, count_if(event_type = 'view') AS overrides_deny, count_if(event_type = 'error') AS overrides_reverse FROM events""")
def learned_summary(spark, sf_dir):
    """What was learned, in figures."""
    r = table(spark, sf_dir, "part").groupBy("p_name").agg((F.min("p_size") < 5).alias("auto"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("auto"))
    d = F.when(F.col("event_type") == "click", "allow").when(F.col("event_type") == "view", "deny").when(F.col("event_type") == "error", "reverse")
    return editlog.learned_summary(r, s, table(spark, sf_dir, "events").select(d.alias("decision")))


@query(demo.duckdb("""SELECT session, id, CASE quantity % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'validated' END AS status, CASE WHEN quantity % 5 = 0 THEN 1 ELSE 2 END AS refs FROM sp"""))
def applied_validation(spark, sf_dir):
    """Validations on the edges, references to rejected claims removed, no edge lost."""
    q = F.col("quantity")
    e = demo.edges(spark, sf_dir, True).withColumn("claim_refs", F.array(F.lit("good"), F.concat(F.lit("k"), "id")))
    status = lambda c: F.struct(c.alias("status"))
    results = e.where(q % 3 < 2).select("session", "id", status(F.when(q % 3 == 0, "rejected").otherwise("validated")).alias("validation"))
    claims = e.select("session", F.concat(F.lit("k"), "id").alias("claim_id"), status(F.when(q % 5 == 0, "rejected")).alias("validation"))
    return layers.apply_validation(e, results, claims).select("session", "id", F.col("validation.status").alias("status"), F.size("claim_refs").alias("refs"))
