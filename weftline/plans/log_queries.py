"""Edit logs, judgements, usage, text and routing over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import routing
from ..functions.text import claim_polarity, epistemic_strength, find_causal_cues, split_sentences
from ..operators import editlog, evaluate, gaps, layers, repair
from ..session import table
from ..sources import files
from ..streaming import logs, state
from . import demo
from .registry import query


def _log(sql: str) -> str:
    return demo.duckdb(sql, demo.EDITS)


_EFFECTIVE = demo.EDITS + ", f AS (SELECT * FROM d WHERE op <> 'revert' AND NOT EXISTS (SELECT 1 FROM d r WHERE r.op = 'revert' AND r.session = d.session AND r.target = d.edit_id))"


@query(demo.duckdb("SELECT session, edit_id, op FROM f", _EFFECTIVE))
def effective_edits(spark, sf_dir):
    """Edits that nobody reverted."""
    return editlog.effective(demo.edits(spark, sf_dir)).select("session", "edit_id", "op")


@query(_log("""SELECT d.session, d.edit_id, max(r.seq) AS last_revert FROM d LEFT JOIN d r ON r.op = 'revert' AND r.session = d.session AND r.target = d.edit_id GROUP BY 1, 2"""))
def annotated_edits(spark, sf_dir):
    """Edits with the last revert that names them."""
    a = editlog.annotate(demo.edits(spark, sf_dir))
    return a.select("session", "edit_id", F.regexp_extract("reverted_by", r"(\d+)", 1).try_cast("long").alias("last_revert"))


@query(demo.duckdb("""SELECT from_label AS from_norm, to_label AS to_norm, count(*) AS n, max(ts) AS ts, count(*) OVER (PARTITION BY from_label) = 1 AS auto FROM f WHERE op = 'rename_node' GROUP BY 1, 2""", _EFFECTIVE))
def learned_renames(spark, sf_dir):
    """Renames by pair, automatic where unique."""
    f = editlog.effective(demo.edits(spark, sf_dir)).where("op = 'rename_node'")
    return editlog.learned_renames(f, F.lower).select("from_norm", "to_norm", "n", "ts", "auto")


@query(demo.duckdb("""SELECT from_label AS label_norm, count(*) AS n, count(*) >= 2 AS auto FROM f WHERE op = 'delete_node' GROUP BY 1""", _EFFECTIVE))
def learned_stoplist(spark, sf_dir):
    """Deleted labels."""
    f = editlog.effective(demo.edits(spark, sf_dir)).where("op = 'delete_node'").withColumn("label", F.col("from_label"))
    return editlog.learned_stoplist(f, F.lower).select("label_norm", "n", "auto")


@query(demo.duckdb("""SELECT from_label AS from_norm, to_label AS to_norm, arg_max(CASE WHEN old_glyph = 'arrow' THEN 'deny' ELSE 'allow' END, session || ' ' || ts) AS decision, count(*) AS n
    FROM f WHERE (op = 'retype_edge' AND old_glyph <> new_glyph) OR (op = 'delete_edge' AND old_glyph = 'arrow') GROUP BY 1, 2""", _EFFECTIVE))  # fmt: skip
def learned_overrides(spark, sf_dir):
    """The last causal decision per pair, and how many there were."""
    return editlog.learned_overrides(editlog.effective(demo.edits(spark, sf_dir)), F.lower).select("from_norm", "to_norm", "decision", "n")


@query("""SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1, 2""")
def latest_wins(spark, sf_dir):
    """The last judgement per key by time, then order."""
    e = table(spark, sf_dir, "events").withColumns({"seq": F.col("event_id"), "ts": F.lpad(F.col("event_id").cast("string"), 12, "0")})
    return evaluate.latest_wins(e, ["user_id", "event_type"]).select("user_id", "event_type", "value", "seq")


@query("""SELECT CASE WHEN grouping(strftime(ts, '%Y-%m-%d')) = 1 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day, sum(event_id % 100) AS input, sum(event_id % 7) AS output, count(*) AS runs, count_if(event_id % 5 = 0) AS cached
    FROM events GROUP BY ROLLUP (strftime(ts, '%Y-%m-%d'))""")
def daily_usage(spark, sf_dir):
    """Use per day and in total."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), (F.col("event_id") % 100).alias("input"), (F.col("event_id") % 7).alias("output"), F.lit(1).alias("calls"), (F.col("event_id") % 5 == 0).alias("cached"))
    return evaluate.daily_usage(e).select("day", "input", "output", "runs", "cached")


@query("""SELECT event_type, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN event_id % 100 END) AS BIGINT) AS input, count(*) AS calls, count_if(event_id % 4 = 0) AS unknown FROM events GROUP BY 1""")
def usage_totals(spark, sf_dir):
    """Accumulated use; missing figures are unknown, not zero."""
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100).alias("input"), F.lit(1).alias("output"))
    return evaluate.usage_totals(e, ["event_type"]).select("event_type", "input", "calls", "unknown")


def _sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_id") % 3 == 0, "correct").when(F.col("event_id") % 3 == 1, "incorrect").otherwise("undecidable")
    ops = F.array(F.struct(F.when(F.col("event_id") % 2 == 0, "delete_edge").otherwise("view").alias("op"), F.lit("").alias("at")))
    return e.select(F.create_map(F.col("event_id").cast("string"), verdict).alias("relation_verdicts"), F.when(F.col("event_id") % 6 != 0, (F.col("event_id") % 5 + 1).cast("int")).alias("satisfaction"), ops.alias("operations"))


@query("""SELECT count_if(event_id % 3 = 1) AS incorrect, count_if(event_id % 3 = 0) AS correct, count_if(event_id % 3 = 2) AS undecidable, round(count_if(event_id % 3 = 1) / count_if(event_id % 3 < 2), 3) AS error_rate FROM events""")
def relation_error_rate(spark, sf_dir):
    """Incorrect among decided verdicts."""
    return evaluate.relation_error_rate(_sessions(spark, sf_dir)).select("incorrect", "correct", "undecidable", "error_rate")


@query("""SELECT count(s) AS n, round(avg(s), 3) AS mean, round(count_if(s >= 4) / count(s), 3) AS share_4_plus FROM (SELECT CASE WHEN event_id % 6 <> 0 THEN event_id % 5 + 1 END AS s FROM events) x""")
def satisfaction_rate(spark, sf_dir):
    """Mean and share of 4 and 5."""
    return evaluate.satisfaction(_sessions(spark, sf_dir)).select("n", "mean", "share_4_plus")


@query("""SELECT count(*) AS maps, count_if(event_id % 2 = 0) AS corrections, round(count_if(event_id % 2 = 0) / count(*), 3) AS per_map FROM events""")
def correction_rate(spark, sf_dir):
    """Correcting operations per map."""
    return evaluate.correction_rate(_sessions(spark, sf_dir)).withColumn("corrections", F.col("corrections").cast("long")).select("maps", "corrections", "per_map")


_GAPS = "SELECT CAST(event_id % 400 AS VARCHAR(5)) AS gap, event_id, CASE WHEN event_type = 'click' THEN 'confirm' WHEN event_type = 'view' THEN 'dismiss' END AS decision FROM events"


@query(f"""SELECT session, count(*) AS total_candidates, count(d) AS decided, count_if(d = 'confirm') AS confirmed, round(CASE WHEN count(d) > 0 THEN count_if(d = 'confirm') / count(d) END, 3) AS usefulness_rate FROM (
    SELECT CAST(CAST(gap AS INTEGER) % 5 AS VARCHAR(5)) AS session, gap, arg_min(decision, event_id) FILTER (WHERE decision IS NOT NULL) AS d FROM ({_GAPS}) g GROUP BY 1, 2) x GROUP BY 1""")
def gap_decisions(spark, sf_dir):
    """The first decision on a gap counts; usefulness among the decided."""
    e = table(spark, sf_dir, "events")
    gap = (F.col("event_id") % 400).cast("string")
    s = (F.col("event_id") % 400 % 5).cast("string")
    g = e.select(s.alias("session"), gap.alias("gap_id"), F.lit("candidate").alias("status")).distinct()
    d = F.when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "view", "dismiss")
    dec = e.select(s.alias("session"), gap.alias("gap_id"), d.alias("decision"), F.lit("u").alias("user_id"), F.lit("t").alias("ts"), F.col("event_id").alias("seq"))
    return gaps.usefulness(gaps.decide(g, dec), ["session"]).select("session", "total_candidates", "decided", "confirmed", "usefulness_rate")


@query("""SELECT gap_id, session, turn FROM (SELECT gap_id, session, row_number() OVER (PARTITION BY session ORDER BY rn, k) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY session, k ORDER BY confidence DESC, gap_id) AS rn FROM (
    SELECT CAST(event_id AS VARCHAR(20)) AS gap_id, CAST(user_id AS VARCHAR(20)) AS session, event_id % 3 AS k, (event_id % 10) / 10 AS confidence FROM events) a) b) c""")
def gap_round_robin(spark, sf_dir):
    """Gaps in turn by type."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "structural").when(F.col("event_id") % 3 == 1, "discourse").otherwise("causal")
    g = e.select(F.col("event_id").cast("string").alias("gap_id"), F.col("user_id").cast("string").alias("session"), kind.alias("gap_type"), (F.col("event_id") % 10 / 10).alias("confidence"))
    return gaps.round_robin(g).select("gap_id", "session", F.col("turn").cast("long").alias("turn"))


_CUES = {"map": ("sh is", "the of"), "basic": ("hello", " a "), "vector": ("ing the", "what is"), "local": (" und ", "er the"), "global": (" les ", "tion of"), "hybrid": (" und der ",), "map_verb": (" to ",), "question": (" en ",)}


def _sql_hit(cues) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{c}') OR contains(text, '{c}')" for c in cues) + ")"


_H = {k: _sql_hit(v) for k, v in _CUES.items()}


@query(f"""SELECT conv_id, turn, CASE WHEN m AND NOT qa THEN 'map' WHEN b AND NOT v AND length(text) <= 200 THEN 'basic' WHEN h OR (l AND g) THEN 'hybrid' WHEN l THEN 'local' WHEN g THEN 'global' WHEN v THEN 'vector' ELSE 'map' END AS route FROM (
    SELECT *, m AND (l OR g) AND (text LIKE '%?' OR q) AND NOT mv AS qa FROM (SELECT conv_id, turn, text, {_H['map']} AS m, {_H['basic']} AS b, {_H['vector']} AS v, {_H['local']} AS l, {_H['global']} AS g, {_H['hybrid']} AS h, {_H['map_verb']} AS mv, {_H['question']} AS q
      FROM conversations WHERE text IS NOT NULL) x) y""")
def message_routes(spark, sf_dir):
    """the route of a message by ordered rules (with cues that occur in these texts)."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", routing.route(F.col("text"), cues=_CUES, short=200).alias("route"))


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '#([^\\s#、,]+)', 1))), ' ') AS tags FROM conversations WHERE text IS NOT NULL""")
def message_tags(spark, sf_dir):
    """the tags of a message."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.array_join(routing.tags(F.col("text")), " ").alias("tags"))


@query("""SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN contains(lower(text), 'shation') THEN 'mechanism:shation' END, CASE WHEN contains(lower(text), 'und der') THEN 'causal_verb:und der' END, CASE WHEN contains(lower(text), 'thereof') THEN 'mechanism:thereof' END], lambda x: x IS NOT NULL)), ',') AS cues FROM documents""")
def causal_cues(spark, sf_dir):
    """Cues of a lexicon that a text has."""
    lex = {"mechanism": ("shation", "thereof"), "causal_verb": ("und der",)}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(find_causal_cues(F.col("text"), lex), ",").alias("cues"))


@query("""SELECT doc_id, CASE WHEN contains(' ' || lower(text) || ' ', ' not ') OR contains(lower(text), 'n''t') OR contains(' ' || lower(text) || ' ', ' no ') OR contains(lower(text), 'fail') OR contains(lower(text), 'without') OR contains(lower(text), 'lack')
    OR contains(lower(text), 'absence') OR contains(lower(text), 'unable') THEN 'negative' ELSE 'positive' END AS polarity FROM documents""")
def claim_polarities(spark, sf_dir):
    """Polarity by negation cues."""
    return table(spark, sf_dir, "documents").select("doc_id", claim_polarity(F.coalesce("text", F.lit(""))).alias("polarity"))


@query("""SELECT l_orderkey, n, score, CASE WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.5 THEN 'moderate' WHEN score >= 0.3 THEN 'weak' ELSE 'minimal' END AS level FROM (
    SELECT l_orderkey, count(*) AS n, round(0.4 * least(1.0, count(*) / 3) + 0.4 * (sum(CAST(l_linenumber AS DOUBLE)) / count(*) / 7) + 0.2 * CASE WHEN max(l_linenumber) > 3 THEN 1 ELSE 0 END, 4) AS score FROM lineitem GROUP BY 1) x""")
def argument_strength(spark, sf_dir):
    """Strength of arguments by grounds, confidence and warrant."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.collect_list(F.col("l_linenumber") / 7.0).alias("c"), F.max("l_linenumber").alias("m"))
    s = epistemic_strength(F.col("c"), F.when(F.col("m") > 3, "w"))
    return g.withColumn("s", s).select("l_orderkey", "n", "s.score", "s.level")


@query("""SELECT source, doc_id, start, length(cut) AS n_cut FROM (SELECT source, doc_id, start, left(text, CAST(48000 - start AS INTEGER)) AS cut FROM (
    SELECT source, doc_id, text, CAST(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents) x WHERE start < 48000) y""")
def character_budget(spark, sf_dir):
    """Newest documents of every source within a budget of characters."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.timestamp_seconds("doc_id").alias("modified"), F.col("doc_id").cast("string").alias("name"), "text")
    return files.within_budget(d, partition=["source"]).select("source", "doc_id", F.col("offset").cast("long").alias("start"), F.length("text").cast("long").alias("n_cut"))


@query(r"""SELECT page_id, md5(regexp_replace(replace(html, '</w:p>', chr(10)), '<[^>]+>', '', 'g')) AS digest FROM pages""")
def markup_text(spark, sf_dir):
    """S3: text of markup."""
    from ..functions.text import extract_text

    return table(spark, sf_dir, "pages").select("page_id", F.md5(extract_text(F.lit("x.docx"), F.col("html").cast("binary")).cast("binary")).alias("digest"))


@query()
def sentence_split(spark, sf_dir):
    """Sentences with stable ids (unit-tested)."""
    d = table(spark, sf_dir, "documents").select(F.explode(split_sentences(F.col("text"), F.col("doc_id").cast("string"))).alias("s"))
    return d.select("s.*")


@query("""SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1 ORDER BY 2 LIMIT 400""")
def distinct_sentences(spark, sf_dir):
    """U8: the first of equal texts."""
    d = table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("document_pos"), F.lit(0).alias("idx"))
    return layers.distinct_sentences(d).select("text", F.col("document_pos").alias("doc_id"))


@query("""SELECT k AS id, pos, repair FROM (SELECT *, CASE WHEN rn > 1 THEN base || '-' || pos ELSE base END AS k, CASE WHEN missing THEN 'missing' WHEN rn > 1 THEN 'duplicate' END AS repair FROM (
    SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS rn FROM (SELECT event_id AS pos, event_type = 'error' AS missing, CASE WHEN event_type = 'error' THEN 'c' || CASE WHEN event_id < 100 THEN lpad(CAST(event_id AS VARCHAR(9)), 3, '0') ELSE left(CAST(event_id AS VARCHAR(9)), 3) END ELSE 'u' || user_id END AS base FROM events) a) b) c""")
def id_repair(spark, sf_dir):
    """Missing and repeated ids."""
    e = table(spark, sf_dir, "events").select(F.lit("s").alias("session"), F.col("event_id").alias("pos"), F.when(F.col("event_type") != "error", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("id"))
    return repair.with_ids(e, "c").select("id", "pos", F.col("id_repair").alias("repair"))


@query("""SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS dangling, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) > 0""")
def dangling_edges(spark, sf_dir):
    """Edges with an end that does not exist, by line."""
    li = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("session"), F.col("l_orderkey"), "l_linenumber", F.concat(F.lit("n"), F.when(F.col("l_quantity") > 45, -1).otherwise(F.col("l_linenumber")).cast("string")).alias("from"), F.lit("x").alias("to"))
    n = spark.range(0, 20).select(F.lit("s").alias("session"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id")).unionByName(spark.createDataFrame([("s", "x")], "session string, id string"))
    kept, gone = repair.split_dangling(n, li)
    all_ = gone.select("l_orderkey", "l_linenumber", F.lit(1).alias("d")).unionByName(kept.select("l_orderkey", "l_linenumber", F.lit(0).alias("d")))
    return all_.groupBy("l_orderkey", "l_linenumber").agg(F.sum("d").alias("dangling"), F.count("*").alias("n")).where("dangling > 0")


@query("""SELECT event_id, age_min, entry FROM (SELECT e.event_id, c.event_id AS entry, CAST(floor((epoch(e.ts) - epoch(c.ts)) / 60) AS BIGINT) AS age_min, row_number() OVER (PARTITION BY e.event_id ORDER BY c.ts DESC) AS rn
    FROM (SELECT * FROM events WHERE event_type = 'view') e JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND c.ts <= e.ts AND floor((epoch(e.ts) - epoch(c.ts)) / 60) <= 360) x WHERE rn = 1""")
def cache_lookup(spark, sf_dir):
    """The newest entry within its time to live."""
    e = table(spark, sf_dir, "events")
    req = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_id")
    cache = e.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("ts").alias("created"), F.col("event_id").alias("entry"))
    return files.cache_lookup(req, cache).where("entry is not null").select("event_id", F.col("age_min").cast("long").alias("age_min"), "entry")


@query("""SELECT CAST(user_id AS VARCHAR(20)) AS session, arg_max(event_type, event_id) AS message FROM events GROUP BY 1""")
def history_titles(spark, sf_dir):
    """The latest message of every session."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("message"), F.col("event_id").alias("seq"))
    return files.titles(e)


@query("""SELECT text, least(5, 5) AS half FROM (SELECT text FROM (SELECT props AS text, max(event_id) AS ts FROM events GROUP BY 1) x ORDER BY ts DESC, text LIMIT 40) y""")
def few_shot_examples(spark, sf_dir):
    """The newest distinct examples."""
    e = table(spark, sf_dir, "events").select(F.col("props").alias("text"), F.col("event_id").alias("ts"))
    return editlog.few_shot(e).select("text", F.lit(5).alias("half"))


def _streamed(spark, sf_dir, name):
    """A table of the driver as a stream over its files; as a pattern the path may be a file or a folder, a plain one only a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 100000 MINUTE""")
def streamed_cache(spark, sf_dir):
    """Entries that a cache of 100,000 minutes to live still has, as a stream with timers."""
    rows = _streamed(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created"))
    name = f"cache_{uuid.uuid4().hex}"
    changes = state.run_all(spark, state.expiring(rows, 100_000), name, "append", f"{files.shared_dir(spark).rstrip('/')}/streams/{name}")
    return state.live(changes).select(F.col("id").cast("long").alias("id"))


@query("""SELECT CAST(event_id AS VARCHAR) AS name, event_type AS text, 'cloud' AS source FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 10 DAY""")
def changed_documents(spark, sf_dir):
    """Documents of a drive (here, the events) that changed since a time, read by executors page by page."""
    since = table(spark, sf_dir, "events").agg(F.date_format(F.min("ts") + F.expr("interval 10 days"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    docs = files.scan_cloud(spark, "weftline.plans.providers:TableDrive", since, path=f"{sf_dir}/events.parquet", name="event_id", modified="ts", text="event_type")
    return docs.select("name", "text", "source")


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streamed_event_counts(spark, sf_dir):
    """Events per day and type, computed as a stream over the files."""
    stream = _streamed(spark, sf_dir, "events")
    name = f"events_{uuid.uuid4().hex}"
    got = logs.run_all(spark, logs.event_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))), name, "complete", f"{files.shared_dir(spark).rstrip('/')}/streams/{name}")
    return got.select(F.to_date("start").alias("day"), "event_type", "n")


def _session_logs(spark, sf_dir):
    e = demo.edits(spark, sf_dir)
    payload = F.when(F.col("op") == "add_node", F.create_map(F.lit("label"), F.col("from_label"))).when(F.col("op") == "rename_node", F.create_map(F.lit("label"), F.col("to_label"))).otherwise(F.create_map(F.lit("glyph"), F.col("new_glyph")))
    e = e.withColumn("payload", payload)
    s = e.select("session").distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(16))).alias("k")
    n = s.select("session", k).select("session", F.concat(F.lit("x"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("x"), F.col("k").cast("string")).alias("label"), F.lit("comm_000").alias("community_id"), F.lit(None).cast("string").alias("origin"))
    g = s.select("session", k).select("session", F.concat(F.lit("x"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("x"), F.col("k").cast("string")).alias("from"), F.concat(F.lit("x"), ((F.col("k") + 1) % 17).cast("string")).alias("to"), F.lit("").alias("label"), F.lit("wave").alias("glyph"), F.lit(None).cast("string").alias("origin"))
    return n, g, e


@query()
def folded_graph(spark, sf_dir):
    """Every session's graph with its edit log folded in (unit-tested)."""
    return editlog.fold(*_session_logs(spark, sf_dir))


@query()
def streamed_fold(spark, sf_dir):
    """The same as a stream of base elements and edits (tested to equal the batch fold)."""
    name = f"fold_{uuid.uuid4().hex}"
    root = f"{files.shared_dir(spark).rstrip('/')}/streams/{name}"
    rows = state.fold_input(*_session_logs(spark, sf_dir))
    rows.write.parquet(f"{root}/in")
    return state.current(state.run_all(spark, state.folded(spark.readStream.schema(rows.schema).parquet(f"{root}/in")), name, "update", f"{root}/state"))
