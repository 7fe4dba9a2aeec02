"""Joins, sets, checks and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ascii_norm, member_fingerprint, sentence_id, sha_prefix
from ..operators import checks, corpus, editlog, evaluate, gaps, graph, layers, levels, repair
from ..session import table
from ..sources import files
from . import demo
from .registry import query


@query("""SELECT DISTINCT p_brand AS label, lower(trim(p_brand)) AS label_norm, left(sha256(p_brand), 8) AS digest, p_brand || '#' || lpad(CAST(p_size AS VARCHAR(9)), 4, '0') || '#' || left(sha256(p_name), 8) AS sentence_id FROM part""")
def identifiers(spark, sf_dir):
    """Normal forms, digests and sentence ids."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("label"), ascii_norm(F.col("p_brand")).alias("label_norm"), sha_prefix(F.col("p_brand"), 8).alias("digest"), sentence_id(F.col("p_brand"), F.col("p_size"), F.col("p_name")).alias("sentence_id")).distinct()


@query("""SELECT c_nationkey, left(sha256(string_agg(DISTINCT c_mktsegment, chr(10) ORDER BY c_mktsegment)), 16) AS fingerprint FROM customer GROUP BY 1""")
def member_fingerprints(spark, sf_dir):
    """P10: order-free hash of a set of members."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(member_fingerprint(F.collect_list("c_mktsegment")).alias("fingerprint"))


@query(demo.duckdb("""SELECT sp.session, sp.id FROM sp LEFT JOIN (SELECT DISTINCT "from", "to" FROM sp WHERE quantity = 50) j ON j."from" = sp."from" AND j."to" = sp."to" WHERE sp.quantity > 5 AND j."from" IS NULL"""))
def unlabeled_relations(spark, sf_dir):
    """Relations that nobody judged, by id or by labels."""
    e = demo.edges(spark, sf_dir, True).select("session", F.col("id").alias("edge_id"), F.col("from").alias("from_norm"), F.col("to").alias("to_norm"), F.lit(None).cast("string").alias("origin"), "quantity")
    lab = e.where("quantity = 50").select(F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("edge_id"), "from_norm", "to_norm")
    lab = lab.unionByName(e.where("quantity <= 5").select("session", "edge_id", F.lit("").alias("from_norm"), F.lit("").alias("to_norm")))
    return evaluate.unlabeled(e, lab).select("session", F.col("edge_id").alias("id"))


@query("""SELECT session, a, b, CAST(rank AS INTEGER) AS rank FROM (SELECT session, a, b, row_number() OVER (PARTITION BY session ORDER BY a, b) AS rank FROM (
    SELECT x.p_brand AS session, x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_partkey < y.p_partkey AND x.p_size % 2 <> y.p_size % 2) p) q WHERE rank <= 30""")
def refute_candidates(spark, sf_dir):
    """Claims that share a concept and differ in polarity, the first 30 of a session."""
    p = table(spark, sf_dir, "part")
    c = p.select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("claim_id"), F.when(F.col("p_size") % 2 == 0, "it is not so").otherwise("it is so").alias("text"), F.array("p_type").alias("concepts"), F.lit(None).cast("string").alias("status"))
    return layers.refute_candidates(c).select("session", "a", "b", "rank")


_TERMS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark"


@query(f"""WITH v AS ({_TERMS}), q AS (SELECT DISTINCT text AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL), h AS (SELECT question, term FROM q JOIN v ON contains(lower(question), term))
    SELECT md5(question) AS question, term FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY length(term) DESC, term) AS rk FROM h WHERE NOT EXISTS (SELECT 1 FROM h l WHERE l.question = h.question AND l.term <> h.term AND contains(l.term, h.term))) x WHERE rk <= 6""")
def question_terms(spark, sf_dir):
    """Vocabulary terms in a question, without those inside a longer one."""
    v = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term")).distinct()
    q = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select(F.col("text").alias("question")).distinct()
    return corpus.known_terms(q, v).select(F.md5(F.col("question").cast("binary")).alias("question"), "term")


_GLOBAL = """WITH m AS (SELECT DISTINCT 'n' || s_nationkey AS community, lower(s_name) AS member FROM supplier), q AS (SELECT conv_id * 1000 + turn AS question, length(text) AS k, conv_id FROM conversations WHERE role = 'user' AND text IS NOT NULL),
    t AS (SELECT question, lpad(CAST(k % 100 AS VARCHAR(3)), 2, '0') AS term FROM q WHERE k % 5 > 0 UNION SELECT question, 'supplier#00000000' || CAST(conv_id % 10 AS VARCHAR(2)) || ' and others' FROM q WHERE k % 5 > 0),
    b AS (SELECT DISTINCT m.member, t.term FROM (SELECT DISTINCT term FROM t) t JOIN (SELECT DISTINCT member FROM m) m ON contains(member, term) OR contains(term, member)),
    z AS (SELECT community, count(*) AS size FROM m GROUP BY 1), sc AS (SELECT question, community, count(*) AS score FROM t JOIN b USING (term) JOIN m USING (member) GROUP BY 1, 2),
    r AS (SELECT * FROM (SELECT q.question, z.community, z.size, coalesce(score, 0) AS score, CAST(row_number() OVER (PARTITION BY q.question ORDER BY coalesce(score, 0) DESC, z.size DESC, z.community) AS INTEGER) AS rank FROM q CROSS JOIN z LEFT JOIN sc ON sc.question = q.question AND sc.community = z.community) x WHERE rank <= 3),
    f AS (SELECT community, list(member ORDER BY member) AS l FROM m GROUP BY 1)
    SELECT question, rank, r.community, array_to_string(l[1:2], '・') || CASE WHEN len(l) > 2 THEN ' ほか ' || (len(l) - 2) || ' 概念' ELSE '' END AS title, CAST(substr(r.community, 2) AS INTEGER) % 2 = 0 AS cached FROM r JOIN f ON f.community = r.community"""


@query(_GLOBAL)
def global_summaries(spark, sf_dir):
    """The best communities for every question of all conversations, with the summaries that a cache has for their sets of members."""
    m = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("community"), F.lower("s_name").alias("member"))
    q = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question"), F.length("text").alias("k"), "conv_id")
    words = F.array(F.lpad((F.col("k") % 100).cast("string"), 2, "0"), F.concat(F.lit("supplier#00000000"), (F.col("conv_id") % 10).cast("string"), F.lit(" and others")))
    terms = q.where("k % 5 > 0").select("question", F.explode(words).alias("term"))
    # The cache has the even nations, and sets of the odd ones as they were before their first member came.
    first = m.groupBy("community").agg(F.min("member").alias("member"))
    even = F.substring("community", 2, 9).cast("int") % 2 == 0
    old = m.where(even).unionByName(m.where(~even).join(first, ["community", "member"], "left_anti"))
    cached = old.groupBy("community").agg(member_fingerprint(F.collect_list("member")).alias("fingerprint")).select("fingerprint", F.concat(F.lit("about "), "community").alias("summary"))
    return corpus.global_materials(m, q, terms, cached).drop("summary")


@query("""SELECT community, score, size, CAST(row_number() OVER (ORDER BY score DESC, size DESC, community) AS INTEGER) AS rank FROM (
    SELECT p_brand AS community, count(DISTINCT p_type) FILTER (WHERE contains(p_type, 'AR')) + count(DISTINCT p_type) FILTER (WHERE contains('LARGE ECONOMY', p_type)) AS score, count(DISTINCT p_type) AS size FROM part GROUP BY 1) x QUALIFY rank <= 3""")
def ranked_communities(spark, sf_dir):
    """The communities that overlap the terms most."""
    m = table(spark, sf_dir, "part").select(F.col("p_brand").alias("community"), F.col("p_type").alias("member"))
    t = spark.createDataFrame([("AR",), ("LARGE ECONOMY",)], "term string")
    return corpus.rank_communities(m, t).select("community", "score", "size", "rank")


@query("""SELECT label_norm, arg_min(name, CASE WHEN local THEN '0' ELSE '1' END || name) AS name, bool_or(local) AS local FROM (SELECT lower(trim(n_name)) AS label_norm, n_name AS name, true AS local FROM nation UNION ALL SELECT lower(trim(upper(n_name))), upper(n_name), false FROM nation
    UNION ALL SELECT lower(r_name), r_name, false FROM region) x GROUP BY 1""")
def document_roster(spark, sf_dir):
    """Local documents before cited files, one per name."""
    n = table(spark, sf_dir, "nation")
    cited = n.select(F.upper("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return files.document_roster(n.select(F.col("n_name").alias("name")), cited).select("label_norm", "name", "local")


@query("""SELECT 's' || user_id AS session, CAST(event_id % 9 AS VARCHAR(9)) AS gap_id, coalesce(max(CASE WHEN event_type = 'click' THEN 'confirmed' END), max(CASE WHEN event_type <> 'click' THEN 'candidate' END)) AS status FROM events GROUP BY 1, 2""")
def merged_gaps(spark, sf_dir):
    """U4: gaps of plans and gold files, gold wins."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), (F.col("event_id") % 9).cast("string").alias("gap_id"), "event_type")
    plan = e.where("event_type <> 'click'").select("session", "gap_id", F.lit("candidate").alias("status")).distinct()
    gold = e.where("event_type = 'click'").select("session", "gap_id", F.lit("confirm").alias("decision")).distinct()
    return evaluate.merge_gaps(plan, gold)


@query(demo.duckdb("""SELECT session, 'self_loop' AS kind, count(*) AS n FROM g WHERE quantity = 7 GROUP BY 1 UNION ALL SELECT session, 'dangling_to', count(*) FROM g WHERE quantity = 8 GROUP BY 1"""))
def graph_violations(spark, sf_dir):
    """dangling ends and self loops."""
    e = demo.edges(spark, sf_dir).withColumn("to", F.when(F.col("quantity") == 7, F.col("from")).when(F.col("quantity") == 8, "nowhere").otherwise(F.col("to")))
    return checks.violations(demo.nodes(spark, sf_dir), e).groupBy("session", "kind").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_brand AS session, p_partkey AS id, CAST(p_partkey * 37 % 2000 AS DOUBLE) AS x, CAST(p_partkey * 91 % 2000 AS DOUBLE) AS y, CAST(p_size * 4 + 20 AS DOUBLE) AS w, CAST(60 AS DOUBLE) AS h FROM part)
    SELECT a.session, a.id AS a, c.id AS b FROM b a JOIN b c ON a.session = c.session AND a.id < c.id AND a.x < c.x + c.w AND c.x < a.x + a.w AND a.y < c.y + c.h AND c.y < a.y + a.h""")
def overlapping_boxes(spark, sf_dir):
    """GR15: rectangles that intersect, by grid cells."""
    p = table(spark, sf_dir, "part")
    b = p.select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 2000).cast("double").alias("x"), (F.col("p_partkey") * 91 % 2000).cast("double").alias("y"), (F.col("p_size") * 4 + 20).cast("double").alias("w"), F.lit(60.0).alias("h"))
    return checks.overlaps(b)


@query("""SELECT doc_id AS idx, source FROM documents d WHERE EXISTS (SELECT 1 FROM documents h WHERE h.source = d.source AND h.n_chars > 5000 AND abs(h.doc_id - d.doc_id) <= 20)""")
def neighbour_sentences(spark, sf_dir):
    """What stands within a window around hits of the same document."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("idx"), "n_chars")
    return layers.neighbour_sentences(d, d.where("n_chars > 5000"), 20).select("idx", F.col("document_id").alias("source"))


@query("""SELECT user_id, event_id, 'e-' || strftime(ts, '%Y%m%d') || '-' || lpad(CAST(row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY event_id) + CASE WHEN user_id % 2 = 0 THEN 7 ELSE 0 END AS VARCHAR(9)), 3, '0') AS edit_id FROM events""")
def edit_numbers(spark, sf_dir):
    """Ids that go on from the largest of their day."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.date_format("ts", "yyyyMMdd").alias("day"), F.col("event_id").alias("seq"))
    known = e.where("cast(session as int) % 2 = 0").select("session", F.concat(F.lit("e-"), "day", F.lit("-007")).alias("edit_id")).distinct()
    return editlog.numbered(e, known).select(F.col("session").cast("long").alias("user_id"), F.col("seq").alias("event_id"), "edit_id")


@query("""WITH RECURSIVE s AS (SELECT 'n' || c_custkey AS c, 'n' || c_nationkey AS p FROM customer UNION SELECT 'n' || s_suppkey, 'n' || s_nationkey FROM supplier), r AS (SELECT c, p FROM s UNION SELECT r.c, s.p FROM r JOIN s ON r.p = s.c)
    SELECT c AS id FROM r WHERE c = p""")
def ontology_cycles(spark, sf_dir):
    """GR5: concepts on a cycle of any length."""
    of = lambda t, c, p: table(spark, sf_dir, t).select(F.lit("s").alias("session"), F.concat(F.lit("n"), F.col(c).cast("string")).alias("child"), F.concat(F.lit("n"), F.col(p).cast("string")).alias("parent"))
    return graph.cycle_members(of("customer", "c_custkey", "c_nationkey").unionByName(of("supplier", "s_suppkey", "s_nationkey"))).select("id")


@query("""SELECT DISTINCT least(x.s_name, y.s_name) AS a, greatest(x.s_name, y.s_name) AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_name < y.s_name""")
def ontology_siblings(spark, sf_dir):
    """Concepts that share a parent."""
    r = table(spark, sf_dir, "supplier").select(F.lit("s").alias("session"), F.col("s_name").alias("child"), F.col("s_nationkey").alias("parent"))
    return graph.siblings(r).select("a", "b")


@query(demo.duckdb("""SELECT session, community, arg_min(community_id, printf('%08d', 10000000 - k) || community_id) AS name FROM (SELECT session, 'k' || (length(id) % 3) AS community, community_id, count(*) AS k FROM n GROUP BY 1, 2, 3) x GROUP BY 1, 2"""))
def community_names(spark, sf_dir):
    """Names by plurality of the members' source communities."""
    n = demo.nodes(spark, sf_dir)
    m = n.select("session", "id", F.concat(F.lit("k"), (F.length("id") % 3).cast("string")).alias("community"))
    none = n.select("session", F.col("community_id").alias("id"), F.lit(None).cast("string").alias("name")).limit(0)
    return levels.community_names(n, m, none)


@query(demo.duckdb("""SELECT DISTINCT session, community_id AS community, CAST((dense_rank() OVER (PARTITION BY session ORDER BY community_id) - 1) % 8 AS INTEGER) AS tint FROM n"""))
def community_tints(spark, sf_dir):
    """Tints by rank."""
    return levels.tints(demo.nodes(spark, sf_dir).select("session", F.col("community_id").alias("community")))


@query(demo.duckdb("""SELECT count(*) FILTER (WHERE NOT u) AS relations, count(*) FILTER (WHERE NOT u AND quantity > 2) AS with_evidence, round(count(*) FILTER (WHERE NOT u AND quantity > 2) / count(*) FILTER (WHERE NOT u), 3) AS rate FROM (SELECT *, quantity = 50 AS u FROM g) x"""))
def evidence_display_rate(spark, sf_dir):
    """Share of extracted relations with evidence."""
    span = F.expr("array(cast(named_struct('document_id', 'd', 'char_start', 0, 'char_end', 1, 'surface', 'x') as struct<document_id:string,char_start:int,char_end:int,surface:string>))")
    e = demo.edges(spark, sf_dir).select(F.when(F.col("quantity") == 50, "user_added").alias("origin"), F.when(F.col("quantity") > 2, span).alias("evidence_span"))
    return evaluate.evidence_display_rate(e).select("relations", "with_evidence", "rate")


@query(demo.duckdb("""SELECT count_if(NOT u AND (glyph = 'arrow' OR d)) AS candidates, count_if(NOT u AND glyph = 'arrow') AS kept, count_if(NOT u AND d) AS demoted, count_if(u) AS user_excluded FROM (SELECT glyph, quantity = 50 AS u, glyph = 'wave' AND quantity % 2 = 0 AS d FROM g) x"""))
def causal_funnel(spark, sf_dir):
    """The causal funnel."""
    c = F.struct(F.when((F.col("glyph") == "wave") & (F.col("quantity") % 2 == 0), "arrow").alias("demoted_from"), F.lit("pass").alias("verifier_verdict"))
    e = demo.edges(spark, sf_dir).select("glyph", F.when(F.col("quantity") == 50, "user_added").alias("origin"), c.alias("causal_check"))
    return evaluate.causal_funnel(e).select("candidates", "kept", "demoted", "user_excluded")


@query(demo.duckdb("""SELECT session, id, CASE WHEN quantity = 50 THEN glyph WHEN quantity % 2 = 0 THEN 'wave' ELSE glyph END AS glyph FROM g"""))
def reconciled_policy(spark, sf_dir):
    """Glyphs of the previous plan for all but users' edges."""
    e = demo.edges(spark, sf_dir).withColumn("origin", F.when(F.col("quantity") == 50, "user_edited"))
    plan = e.where("quantity % 2 = 0").select("session", "id", F.lit("wave").alias("glyph"), "label")
    return editlog.reconcile_policy(e, plan).select("session", "id", "glyph")


@query(demo.duckdb("""SELECT session, id, CASE WHEN degree = 0 THEN 'confirmed' ELSE 'candidate' END AS status FROM deg WHERE degree <= 1""", demo.BASE + """, ends AS (SELECT session, "from" AS id, "to" AS other FROM sp UNION ALL SELECT session, "to", "from" FROM sp),
    deg AS (SELECT nw.session, nw.id, count(DISTINCT other) AS degree FROM nw LEFT JOIN ends USING (session, id) GROUP BY 1, 2)"""))  # fmt: skip
def carried_decisions(spark, sf_dir):
    """Decisions carried over to gaps that are detected again."""
    g = gaps.structural(demo.nodes(spark, sf_dir, True), demo.ends(spark, sf_dir, True))
    old = g.where("gap_id like 'gap-isolated-%'").withColumn("status", F.lit("confirmed"))
    return gaps.carry_decisions(g, old).select("session", F.get("related_node_ids", F.lit(0)).alias("id"), "status")


@query("""SELECT p_brand AS session, p_partkey AS id, CAST(pos AS INTEGER) AS pos, CAST(floor(pos / 50) AS BIGINT) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part) x""")
def sentence_batches(spark, sf_dir):
    """Batches of fixed size."""
    return layers.batches(table(spark, sf_dir, "part").select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("id")), 50, ["id"], "session")


@query("""SELECT s_nationkey AS k, upper(s_name) AS concept FROM supplier WHERE s_suppkey % 3 = 0""")
def repaired_concepts(spark, sf_dir):
    """Answers mapped to known labels, hallucinated ones dropped."""
    s = table(spark, sf_dir, "supplier")
    raw = s.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("pos"), F.concat(F.lit(" "), "s_name").alias("concept"))
    known = s.where("s_suppkey % 3 = 0").select(F.upper("s_name").alias("label"), F.col("s_suppkey").alias("pos"))
    return repair.repair_concepts(raw, known, ascii_norm).select(F.col("key").alias("k"), "concept")


@query("""SELECT text FROM (SELECT *, sum(length(text) + 1) OVER (ORDER BY p, r, text ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY p, r, text) AS pos FROM (
    SELECT text, min(p) AS p, arg_min(r, p * 100 + r) AS r FROM (SELECT text, 0 AS p, row_number() OVER (ORDER BY ts DESC, text) AS r FROM (SELECT p_type || p_size AS text, max(p_partkey) AS ts FROM part GROUP BY 1) a QUALIFY r <= 5
      UNION ALL SELECT text, 1, row_number() OVER (ORDER BY n DESC, text) AS r FROM (SELECT p_type || p_size AS text, count(*) AS n FROM part GROUP BY 1) b QUALIFY r <= 5) c GROUP BY 1) d) e WHERE used <= 600 AND pos <= 10""")
def prompt_hints(spark, sf_dir):
    """The newest and the most frequent hints within a budget."""
    i = table(spark, sf_dir, "part").groupBy(F.concat("p_type", F.col("p_size").cast("string")).alias("text")).agg(F.max("p_partkey").alias("ts"), F.count("*").alias("n"))
    return editlog.prompt_hints(i).select("text")


@query("""SELECT user_id, event_id, kind, pos FROM (SELECT user_id, event_type AS kind, min(event_id) AS event_id, min(event_id) AS pos, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS r FROM events GROUP BY 1, 2) x WHERE r <= 3""")
def first_sources(spark, sf_dir):
    """The first distinct sources of every gap."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("gap_id"), F.col("event_type").alias("kind"), F.lit("s").alias("session"), F.lit("d").alias("document_id"), F.lit("l").alias("label"), F.col("event_id").alias("pos"))
    return gaps.first_sources(e, 3).select(F.col("gap_id").alias("user_id"), F.col("pos").alias("event_id"), "kind", "pos")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'interrupted' ELSE event_type END AS status FROM events) x GROUP BY 1""")
def interrupted_jobs(spark, sf_dir):
    """What ran at a restart is interrupted."""
    j = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise(F.col("event_type")).alias("status"))
    return files.interrupted(j).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'label_differs' ELSE 'ok' END AS status FROM customer""")
def reconciled_scene(spark, sf_dir):
    """A drawn scene against its plan."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    drawn = c.where("id % 5 <> 0").withColumn("label", F.when(F.col("id") % 7 == 0, "?").when(F.col("id") % 3 == 0, F.concat(F.left("label", F.lit(4)), F.lit("�"))).otherwise(F.col("label")))
    return checks.reconcile(c, drawn)


@query(demo.duckdb("""SELECT session, "from", "to", glyph, id FROM sp WHERE "to" <> 'Supplier#000000003'"""))
def resolved_ends(spark, sf_dir):
    """Ends given by id or by label."""
    n = demo.nodes(spark, sf_dir, True).where("id <> 'Supplier#000000003'")
    known = n.withColumn("id", F.concat(F.lit("n:"), "id"))
    e = demo.edges(spark, sf_dir, True, ("glyph", "confidence")).withColumn("from", F.when(F.col("confidence") > 0.95, F.concat(F.lit("n:"), "from")).otherwise(F.col("from")))
    out = repair.resolve_ends(e, known, ascii_norm)
    bare = lambda c: F.regexp_replace(c, "^n:", "")
    return out.select("session", bare("from").alias("from"), bare("to").alias("to"), "glyph", "id")


def _supply(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")).agg(F.count("*").cast("double").alias("weight"))


@query()
def corpus_communities(spark, sf_dir):
    """GR4: two levels of communities of suppliers and parts, with their modularity (tested against SQL over the result)."""
    p = _supply(spark, sf_dir)
    return corpus.two_level_communities(p, p.select(F.explode(F.array("a", "b")).alias("label_norm")).distinct())


@query()
def corpus_community_steps(spark, sf_dir):
    """GR4: communities and modularity after every step of moves and contractions (tested against SQL over the result)."""
    steps = corpus.community_steps(_supply(spark, sf_dir))
    return steps.groupBy("level", "step").agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities"), F.max("modularity").alias("modularity"))


@query()
def node_importance(spark, sf_dir):
    """Importance of every node of every session (unit-tested)."""
    n = demo.nodes(spark, sf_dir).withColumns({"mentions": F.lit(None).cast("double"), "novelty": F.lit(None).cast("double")})
    return levels.importance(n, demo.edges(spark, sf_dir))


@query(demo.duckdb("""SELECT session, id, max(CASE WHEN glyph = 'isa' THEN 3000 WHEN glyph = 'double' THEN 2000 ELSE 1000 END) AS importance FROM (SELECT session, "to" AS id, glyph FROM g) x GROUP BY 1, 2"""))
def importance_of_levels(spark, sf_dir):
    """Importance from the most detailed level that has the node."""
    g = demo.edges(spark, sf_dir)
    lv = F.when(F.col("glyph") == "isa", "detailed").when(F.col("glyph") == "double", "standard").otherwise("overview")
    imp = F.when(lv == "detailed", 3000).when(lv == "standard", 2000).otherwise(1000)
    return files.importance_of(g.select("session", F.col("to").alias("id"), lv.alias("level"), imp.alias("importance"), F.lit(False).alias("is_aggregate")).distinct())
