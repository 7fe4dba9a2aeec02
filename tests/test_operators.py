"""Rules of the graph engine, one small test each."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline import schema as S
from weftline.functions import relations, routing, text
from weftline.operators import community, corpus, editlog, evaluate, gaps, graph, layers, levels, repair
from weftline.sources import files
from weftline.streaming import logs

SPAN = S.SPANS


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def nodes(spark, rows):
    return spark.createDataFrame([("s", i, i, c) for i, c in rows], "session string, id string, label string, community_id string").selectExpr(
        "*", f"cast(array() as {SPAN}) as evidence_span", "cast(null as string) as onto_class", "cast(null as array<string>) as claim_refs", "cast(null as double) as mentions", "cast(null as double) as novelty", "cast(null as string) as origin"
    )


def edges(spark, rows):
    df = spark.createDataFrame([("s", i, a, b, g, c) for i, a, b, g, c in rows], "session string, id string, `from` string, `to` string, glyph string, confidence double")
    return df.selectExpr(
        "*", "'' as label", f"cast(array() as {SPAN}) as evidence_span", f"cast(null as {S.TAGS}) as layer_tags", "cast(null as string) as origin", "cast(null as string) as causal_override",
        "cast(null as struct<status:string,combined:double,scores:map<string,double>>) as validation",
        "cast(null as struct<lexicon_hit:array<string>,verifier_verdict:string,demoted_from:string,reason:string>) as causal_check", "cast(null as string) as polarity",
    )


def test_normalised_labels(spark):
    r = one(spark, a=text.normalize_label(F.lit("ＡＩ ")), b=text.normalize_label(F.lit("Straße")), c=text.normalize_label(F.lit(None).cast("string")), d=text.normalize_message(F.lit(" ａ \n  b ")))
    assert tuple(r) == ("ai", "strasse", "", "a b")


@pytest.mark.parametrize(
    "t,want",
    [
        ("", []), ("  ", []), ("一つ。二つ！？三つ", ["一つ。", "二つ！？", "三つ"]), ("A (why? no) b! c", ["A (why? no) b!", "c"]), ("a\nb\n\nc", ["a\nb", "c"]),
        ("x" * 1100, ["x" * 500, "x" * 500, "x" * 100]), ("No stop. Here", ["No stop. Here"]), ("（a\n\nb）c", ["（a\n\nb）c"]), ("(a!)\n\nb", ["(a!)", "b"]),
    ],
)
def test_sentences(t, want):
    assert [t[a:b] for a, b in text.sentence_spans(t)] == want


def test_sentence_ids_are_stable(spark):
    r = one(spark, s=text.split_sentences(F.lit("a! b"), F.lit("doc"))).s
    assert [x.sentence_id[:8] for x in r] == ["doc#0000", "doc#0001"] and [x.text for x in r] == ["a!", "b"]


def test_cues_and_labels(spark):
    r = one(spark, a=text.find_causal_cues(F.lit("X Causes Y via the 機序")), b=text.demoted_label(F.lit("⇒ leads")), c=text.demoted_label(F.lit("〜 ")), d=text.claim_polarity(F.lit("It did not")), e=text.only_correlation(F.lit("Correlated")))
    assert tuple(r) == (["causal_verb:causes", "mechanism:via the", "mechanism:機序"], "leads", "関連", "negative", True)


def test_widths_and_json(spark):
    r = one(spark, a=text.display_width(F.lit("日a")), b=text.truncate(F.lit("日本語日本語"), 3.0), c=text.wrap_lines(F.lit("日本語日本語"), 2.0, 2), d=text.extract_json(F.lit('so {x} {"a": [1, {"b": 2}]} end')), e=text.extract_json(F.lit("none")))
    assert (r.a, r.b, r.c, json.loads(r.d), r.e) == (1.55, "日本…", ["日本", "語…"], {"a": [1, {"b": 2}]}, None)


def test_scores_missing_is_not_zero(spark):
    n = F.lit(None).cast("double")
    j = lambda **k: relations.judge({**{x: n for x in S.VERIFIER_WEIGHTS}, **{a: F.lit(b) for a, b in k.items()}})
    r = one(spark, a=j(), b=j(ontology=1.0), c=j(nli=0.9, llm=0.9), d=j(nli=0.1), e=relations.blend(F.lit(1.0), F.lit(0.5)))
    assert (r.a.status, r.a.combined, r.b.status, r.b.combined, r.c.status, r.d.status, r.e) == ("uncertain", None, "uncertain", 1.0, "validated", "rejected", 0.75)


def test_policy(spark):
    e = edges(spark, [("1", "a", "b", "arrow", 1.0), ("2", "a", "b", "arrow", 1.0), ("3", "a", "b", "zigzag", 1.0), ("4", "a", "b", "arrow", 1.0), ("5", "a", "b", None, 1.0)])
    e = e.withColumns({"label": F.when(F.col("id") == "1", "X causes Y").otherwise("⇒ correlat"), "causal_override": F.when(F.col("id") == "4", "allow")})
    r = {x.id: x for x in relations.apply_relation_policy(e).collect()}
    assert [r[i].glyph for i in "12345"] == ["arrow", "wave", "tension", "arrow", "wave"]
    assert r["2"].label == "correlat" and r["2"].causal_check.demoted_from == "arrow" and r["2"].causal_check.reason == "correlation only" and r["1"].causal_check.lexicon_hit == ["causal_verb:causes"]
    assert relations.apply_relation_policy(e, require_verifier=True).where("id = '1'").first().glyph == "wave"
    assert relations.apply_relation_policy(e, verdict=F.lit(False)).where("id = '1'").first().outcome == "refused"


def test_routes(spark):
    want = {"概念地図を作って": "map", "こんにちは": "basic", "AとBの関係を教えて": "local", "全体像をまとめて": "global", "比較して": "hybrid", "Xとは": "vector", "今週の資料": "map", "xyz": "map", "概念地図でのAの影響は?": "local"}
    df = spark.createDataFrame(list(want.items()), "m string, r string").withColumn("got", routing.route(F.col("m")))
    assert {x.m: x.got for x in df.collect()} == want
    now = dt.datetime(2024, 5, 15, 10, 30)
    for m in ("過去 3 日", "先週", "今月", "今週", "x"):
        got = one(spark, w=routing.window_start(F.lit(m), F.lit(now))).w
        assert got == routing.parse_window(m, now), m
    r = one(spark, t=routing.tags(F.lit("#b #a、#b,c")), d=routing.detail_level(F.lit("詳しく全体像")), lang=routing.language(F.lit("in English")))
    assert tuple(r) == (["a", "b"], "detailed", "en")


def test_graph_degrees_betweenness_communities(spark):
    n = nodes(spark, [(x, "c") for x in "abcdef"])
    e = edges(spark, [("1", "a", "b", "wave", 0.0), ("2", "b", "a", "wave", 0.5), ("3", "b", "c", "wave", 0.5), ("4", "c", "c", "wave", 1.0), ("5", "c", "zz", "wave", 1.0), ("6", "c", "d", "wave", None)])
    assert {tuple(r)[1:] for r in graph.undirected(n, e).collect()} == {("a", "b", 1.5, 2), ("b", "c", 0.5, 1), ("c", "d", 1.0, 1)}
    d = {r.id: (r.degree, r.incident) for r in graph.degree(n, e).collect()}
    assert d == {"a": (1, 2), "b": (2, 3), "c": (2, 2), "d": (1, 1), "e": (0, 0), "f": (0, 0)}
    b = {r.id: r.betweenness for r in graph.betweenness(n, e).collect()}
    assert b == {"a": 0, "b": 0.2, "c": 0.2, "d": 0, "e": 0, "f": 0}
    got = community.leiden(list("abcdefgh"), [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1), ("c", "d", 1)])
    assert got == {**dict.fromkeys("abc", "comm_000"), **dict.fromkeys("def", "comm_001"), "g": "comm_002", "h": "comm_003"}
    assert community.communities(n, e).count() == 6


def test_corpus_propagation_and_components(spark):
    p = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("c", "x", 0.1)], "a string, b string, weight double")
    assert {r.id: r.component for r in graph.connected_components(p).collect()} == dict.fromkeys("abcxy", "a")
    lab = {r.id: r.community for r in community.corpus_levels(p).where("step = 0").collect()}
    assert lab == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_neighborhood_truncation(spark):
    n = nodes(spark, [(x, "c") for x in "abcd"])
    e = edges(spark, [("1", "a", "b", "wave", 1.0), ("2", "a", "c", "wave", 1.0), ("3", "c", "d", "wave", 1.0)])
    got, inner = graph.neighborhood(n, e, n.where("id = 'a'"), 2, 3)
    assert [(r.id, r.hop, r.truncated) for r in got.orderBy("hop", "id").collect()] == [("a", 0, True), ("b", 1, True), ("c", 1, True)] and inner.count() == 2
    assert not graph.neighborhood(n, e, n.where("id = 'a'"), 2, 4)[0].first().truncated


def test_ontology(spark):
    r = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "d", "c"), ("s", "e", "c")], "session string, child string, parent string")
    assert {x.id for x in graph.cycle_members(r).collect()} == {"a", "b", "c"}
    assert {(x.a, x.b) for x in graph.siblings(r).collect()} == {("b", "d"), ("b", "e"), ("d", "e")}
    o = r.selectExpr("session", "child as src", "parent as dst", "'is_a' as relation").unionByName(spark.createDataFrame([("s", "d", "c", "part_of")], "session string, src string, dst string, relation string"))
    e = spark.createDataFrame([("s", "1", "a", "b", "is_a"), ("s", "2", "d", "c", "is_a"), ("s", "3", "e", "d", "causes"), ("s", "4", "x", "y", "causes")], "session string, id string, src string, dst string, relation string")
    assert {x.id: x.ontology_score for x in graph.ontology_scores(e, o).collect()} == {"1": 0.0, "2": 0.0, "3": 0.5, "4": 1.0}


def test_skeleton_layers_roots(spark):
    e = edges(spark, [("1", "a", "b", "arrow", 0.9), ("2", "b", "c", "arrow", 0.8), ("3", "c", "a", "arrow", 0.1), ("4", "a", "c", "arrow", 0.5)])
    dag = graph.acyclic_skeleton(e)
    assert {r.id for r in dag.collect()} == {"1", "2", "4"}
    assert {r.id: r.layer for r in graph.longest_path_layers(dag).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.id for r in graph.tree_roots(nodes(spark, [(x, "c") for x in "abc"]), dag).collect()} == {"a"}


def brute_order(rows):
    """Ids in quota order: pins, one of each community without a pin (larger ones first), the rest by total."""
    by = sorted(rows, key=lambda r: (-r[2], r[0]))
    out = [r for r in by if r[3]]
    size = {c: sum(r[1] == c for r in rows) for c in {r[1] for r in rows}}
    for c in sorted(size, key=lambda c: (-size[c], c)):
        if not any(r[3] and r[1] == c for r in rows):
            out.append(next(r for r in by if r[1] == c))
    return out + [r for r in by if r not in out]


def brute_selection(rows, lo, hi, ratio, least=2):
    """What the contract says, by trying every size."""
    order = brute_order(rows)
    groups = {r[1] for r in rows}
    pins = sum(r[3] for r in rows)

    def folded(shown):
        return sum(sum(r[1] == c and r not in shown for r in rows) >= least for c in groups)

    k = len(rows) if len(rows) <= lo else min(hi, len(rows), max(lo, round(ratio * len(rows))))
    floor = max(len(groups), pins)
    if k > floor:
        k = next((x for x in range(k, floor - 1, -1) if x + folded(order[:x]) <= hi), floor)
    shown = order[: max(k, pins)]
    for c in sorted(groups, key=lambda c: (max(r[2] for r in rows if r[1] == c), c)):
        own = [r for r in rows if r[1] == c]
        if len(shown) + folded(shown) > hi and len(own) >= least and sum(r in shown for r in own) == 1 and not any(r[3] for r in own if r in shown):
            shown = [r for r in shown if r not in own]
    return {r[0] for r in shown}


def test_selection_stays_in_band(spark):
    random.seed(3)
    cases = [(n, g, p) for n in (1, 8, 30, 55, 120, 200) for g in (1, 6, 25, 90) for p in (0, 3, 30) if g <= n and p <= n]
    data = {f"s{k}": [(f"n{i:03d}", f"c{random.randrange(g)}", random.choice([random.random(), 0.5]), i < p) for i in range(n)] for k, (n, g, p) in enumerate(cases)}
    df = spark.createDataFrame([(s, *r) for s, rows in data.items() for r in rows], "session string, id string, community string, total double, pinned boolean")
    got = {}
    for r in levels.select_nodes(df).collect():
        got.setdefault((r.session, r.level), set()).add(r.id)
    shrunk = 0
    for s, rows in data.items():
        for lv, (lo, hi) in S.LEVEL_BANDS.items():
            want = brute_selection(rows, lo, hi, S.LEVEL_RATIO[lv])
            assert got.get((s, lv), set()) == want, (s, lv)
            shrunk += len(want) < min(hi, len(rows), max(lo, round(S.LEVEL_RATIO[lv] * len(rows))))
    assert shrunk > 10
    for k in (3, 10, 50):
        chosen = {}
        for r in levels.select_k(df, k).collect():
            chosen.setdefault(r.session, set()).add(r.id)
        assert all(chosen[s] == {r[0] for r in brute_order(rows)[: max(k, sum(r[3] for r in rows))]} for s, rows in data.items())


def test_analysis_of_levels(spark):
    rows = [(f"c{i:03d}", f"src_{i % 3}") for i in range(60)]
    e = [(f"e{i}", f"c{i:03d}", f"c{(i + 3) % 60:03d}", "wave", 0.8) for i in range(60)]
    out = levels.analyze(nodes(spark, rows), edges(spark, e))
    count = {r.level: r["count"] for r in out["visible"].groupBy("level").count().collect()}
    assert count["detailed"] == 60 and count["overview"] <= 20 and out["edges"].where("level = 'detailed'").count() == 60
    assert levels.expand(out["aggregates"]).where("level = 'overview'").count() <= 60 - count["overview"]


def test_frozen_communities(spark):
    n = nodes(spark, [("a", "x"), ("b", "x"), ("c", "x"), ("d", None)])
    e = edges(spark, [("1", "a", "b", "wave", 1.0), ("2", "b", "c", "wave", 1.0)])
    frozen = spark.createDataFrame([("s", "a", "k")], "session string, id string, community string")
    assert {r.id: r.community for r in levels.frozen_communities(n, e, frozen).collect()} == {"a": "k", "b": "k", "c": "k", "d": "comm_000"}
    # Rounds in the order of ids, each seeing what the round has given already.
    random.seed(9)
    for _ in range(30):
        ids = [f"n{i}" for i in range(14)]
        near = {i: set() for i in ids}
        for a, b in (random.sample(ids, 2) for _ in range(16)):
            near[a].add(b)
            near[b].add(a)
        known = {i: random.choice("xyz") for i in random.sample(ids, 3)}
        want, size = dict(known), 0
        while size != len(want):
            size = len(want)
            for i in sorted(ids):
                seen = [want[j] for j in near[i] if j in want]
                if i not in want and seen:
                    want[i] = min(seen, key=lambda c: (-seen.count(c), c))
        assert levels._spread(dict.fromkeys(ids), dict(known), near) == want


def test_gaps(spark):
    n = nodes(spark, [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "y")]).withColumn("claim_refs", F.when(F.col("id") == "a", F.array(F.lit("cl-1"))))
    e = edges(spark, [("1", "a", "b", "wave", 1.0), ("2", "c", "d", "wave", 1.0)]).withColumns({
        "layer_tags": F.expr(f"cast(named_struct('layer_A', array(), 'layer_B', array(), 'layer_C', array('causes'), 'layer_D', array()) as {S.TAGS})"),
        "validation": F.expr("case when id = '1' then cast(named_struct('status', 'rejected', 'combined', 0.2, 'scores', map()) as struct<status:string,combined:double,scores:map<string,double>>) end"),
    })
    c = spark.createDataFrame([("s", "y", "Y", True)], S.COMMUNITY)
    got = [r.gap_id for r in gaps.detect(n, e, c).orderBy("rank").collect()]
    assert got == ["gap-isolated-e", "gap-causal-1", "gap-declared-y", "gap-discourse-a", "gap-bridge-x-y", "gap-weak-a", "gap-weak-b", "gap-weak-c", "gap-weak-d"]


def test_fold_and_its_set_based_form(spark):
    random.seed(1)
    n = nodes(spark, [(x, "c") for x in "abcd"])
    e = edges(spark, [(f"e{i}", random.choice("ab"), random.choice("cd"), "wave", 1.0) for i in range(12)])
    log = [("s", f"e-{i:03d}", random.choice(editlog.EDGE_OPS[:3] + ("delete_edge",)), f"e{random.randrange(12)}", {"label": f"l{i}", "glyph": random.choice(S.GLYPHS)}, i) for i in range(40)]
    log += [("s", "e-900", "revert", "e-003", None, 900)]
    d = spark.createDataFrame(log, "session string, edit_id string, op string, target string, payload map<string,string>, seq long")
    keys = ["id", "from", "to", "label", "glyph", "origin"]
    a = {tuple(r) for r in editlog.fold(n, e, d).where("kind = 'edge'").select(keys).collect()}
    assert a == {tuple(r) for r in editlog.fold_edges_set_based(e, d).select(keys).collect()}


def test_fold_rules(spark):
    n, e = nodes(spark, [("a", "x"), ("b", "x")]), edges(spark, [("1", "a", "b", "wave", 1.0)])
    log = [("add_node", None, {"label": "N", "new_island": "true"}), ("add_edge", None, {"from": "a", "to": "un-1", "glyph": "arrow"}), ("add_edge", None, {"from": "a", "to": "a"}), ("delete_node", "b", {}), ("rename_node", "zz", {"label": "q"}), ("rename_node", "a", {"label": "A2"})]
    d = spark.createDataFrame([("s", f"e-{i + 1}", op, t, p, i) for i, (op, t, p) in enumerate(log)], "session string, edit_id string, op string, target string, payload map<string,string>, seq long")
    rows = editlog.fold(n, e, d).collect()
    assert {(r.id, r.label, r.community_id) for r in rows if r.kind == "node"} == {("a", "A2", "x"), ("un-1", "N", "comm_user_1")}
    assert [(r.id, r["from"], r["to"]) for r in rows if r.kind == "edge"] == [("ue-2", "a", "un-1")]
    assert sum(r.kind == "warning" for r in rows) == 2
    assert {r.id for r in editlog.pins(d, e).collect()} >= {"a", "un-1"}


def test_matching_judgements(spark):
    e = spark.createDataFrame([("1", "r1", "a", "b", "arrow", None), ("2", "r1", "a", "b", "wave", None), ("2", "r2", "c", "d", "wave", "user_added")], "session string, edge_id string, from_norm string, to_norm string, glyph string, origin string")
    lab = spark.createDataFrame(
        [("1", "r1", "", "", "correct", True, "t1", 1), (None, None, "a", "b", "incorrect", None, "t2", 2), ("1", "zz", "a", "b", "incorrect", None, "t3", 3), (None, None, "c", "d", "correct", None, "t1", 4), ("9", "q", "", "", "correct", None, "t1", 5)],
        "session string, edge_id string, from_norm string, to_norm string, verdict string, causal_ok boolean, ts string, seq long",
    )
    m = {(r.m_session, r.m_edge_id): (r.status, r.verdict) for r in evaluate.match_labels(lab, e).collect()}
    assert m == {("1", "r1"): ("matched", "incorrect"), ("2", "r1"): ("matched", "incorrect"), ("2", "r2"): ("user_origin", "correct"), ("9", "q"): ("missing", "correct")}
    r = evaluate.offline_metrics(evaluate.match_labels(lab, e), 3).first()
    assert (r.relation_accuracy, r.causal_precision, r.judged_relations, r.missing) == (0.0, None, 2, 1)


def test_repairs(spark):
    r = one(
        spark, a=repair.evidence_spans(F.lit('{"documentId": "d", "charStart": 1, "charEnd": 3, "surface": "x"}')), b=repair.evidence_spans(F.lit('["p", {"surface": "q", "char_start": 5}]')),
        c=repair.evidence_spans(F.lit("null")), d=repair.evidence_spans(F.lit('"bare"')), e=repair.claim_refs(F.lit('["a", "b", "a", 3]')), f=repair.claim_refs(F.lit('"a"')), g=repair.clamp_confidence(F.lit("1.7")), h=repair.clamp_confidence(F.lit("x")),
    )
    assert [tuple(x) for x in r.a] == [("d", 1, 3, "x")] and [x.surface for x in r.b] == ["p", "q"] and r.b[1].char_start is None and r.c == [] and [x.surface for x in r.d] == ["bare"]
    assert (r.e, r.f, r.g, r.h) == (["a", "b"], ["a"], 1.0, None)


def test_merge_fragment(spark):
    n, e = nodes(spark, [("c000", "x"), ("c001", "x")]).select("session", "id", "label", "community_id"), edges(spark, [("r0", "c000", "c001", "wave", 0.5)])
    new = spark.createDataFrame([("s", "f1", " C000 ", "x", 0), ("s", "f2", "fresh", "x", 1), ("s", "f3", "too many", "x", 2)], "session string, id string, label string, community_id string, pos int")
    fe = edges(spark, [("q1", "f1", "f2", "arrow", 0.9), ("q2", "f2", "f3", "arrow", 0.9), ("q3", "f1", "f1", "arrow", 0.9)])
    a, b, m = repair.merge_fragment(n, e, new, fe, most=3)
    assert {(r.id, r.label) for r in a.collect()} == {("c000", "c000"), ("c001", "c001"), ("c002", "fresh")}
    assert {(r["from"], r["to"]) for r in b.collect()} == {("c000", "c001"), ("c000", "c002")} and m.count() == 2


def test_claims_and_layers(spark):
    c = spark.createDataFrame([("s", 0, "cl-1", "heat will increase", ["Heat"], None), ("s", 1, "cl-2", "heat will decrease", ["heat "], None), ("s", 2, "cl-3", "cold is not so", ["cold"], None), ("s", 3, "cl-4", "heat is not there", ["heat"], "rejected")], "session string, pos int, claim_id string, text string, concepts array<string>, status string")
    assert [(r.a, r.b) for r in layers.refute_candidates(c).collect()] == [("cl-1", "cl-2")]
    z = spark.createDataFrame([("s", "we did a long test", "Method", 0), ("s", "we did", "Result", 1)], "session string, text string, zone_label string, pos int")
    t = spark.createDataFrame([("s", "we did"), ("s", "did a long test"), ("s", "short")], "session string, text string")
    assert {r.text: r.zone_label for r in layers.zone_of_text(t, z, ["session"]).collect()} == {"we did": "Result", "did a long test": "Method"}


def test_corpus_of_two_sessions(spark):
    n = spark.createDataFrame([("1", "a", "機械学習", "k", "", 0.9), ("1", "b", "ＡＩモデル", "k", "", 0.2), ("2", "z", "機械学習 ", "k", "bfo:Process", 0.5)], "session string, id string, label string, community_id string, onto_class string, importance double")
    m = {r.label_norm: r for r in corpus.merge_nodes(n).collect()}
    assert m["機械学習"].label == "機械学習 " and m["機械学習"].importance == 0.9 and m["機械学習"].onto_class == "bfo:Process" and [s.session for s in m["機械学習"].sources] == ["2", "1"] and "aiモデル" in m
    q = spark.createDataFrame([("What of machine learning and learning?",)], "question string")
    v = spark.createDataFrame([("learning",), ("machine learning",), ("other",)], "term string")
    assert [r.term for r in corpus.known_terms(q, v).collect()] == ["machine learning"]


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.docx").write_text("<w:p>one</w:p><w:p>two</w:p>")
    (tmp_path / "c.bin").write_text("no")
    got = {r.name: r.text for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "plain", "b.docx": "one\ntwo\n"}
    log = tmp_path / "u.jsonl"
    log.write_text('// head\n\n{"ts": "2024-01-01T00:00:00", "input": 3}\nbroken{\n{"ts": "2024-01-02", "input": null}\n')
    rows = files.read_log(spark, str(log), S.USAGE).collect()
    assert [(r.ts, r.input) for r in rows] == [("2024-01-01T00:00:00", 3), ("2024-01-02", None)]
    (tmp_path / "kg_session_20260101_000000.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}], "edges": [{"id": "r", "from": "a", "to": "a"}], "communities": []}))
    (tmp_path / "kg_session_bad name.json").write_text("{}")
    n, e, _ = files.read_graphs(spark, str(tmp_path))
    assert [(r.session, r.id) for r in n.collect()] == [("20260101_000000", "a")] and e.count() == 1
    assert [r.session for r in files.session_names(spark, str(tmp_path)).collect()] == ["20260101_000000"]


def test_document_resolution(spark):
    ids = spark.createDataFrame([("a.pdf",), ("dir/b.txt",), ("c",), ("long-rep",), ("?",)], "document_id string")
    names = spark.createDataFrame([("a.pdf",), ("b.txt",), ("c.md",), ("my-long-report.pdf",)], "name string")
    assert {r.document_id: r.name for r in files.resolve_documents(ids, names).collect()} == {"a.pdf": "a.pdf", "dir/b.txt": "b.txt", "c": "c.md", "long-rep": "my-long-report.pdf", "?": None}


def test_index_heals_itself(spark, tmp_path):
    path = str(tmp_path / "index")
    n = spark.createDataFrame([("a", "A", "", 0.1, [("1", "x")])], "label_norm string, label string, onto_class string, importance double, sources array<struct<session:string,node_id:string>>")
    e = spark.createDataFrame([("a", "b", "wave", "l", 1, [("1", "r")])], "from_norm string, to_norm string, glyph string, label string, weight int, sources array<struct<session:string,edge_id:string>>")
    built = []
    make = lambda: (built.append(1), files.build_index(n, e, path, "v1"))
    for want in (1, 1):
        a, b = files.open_index(spark, path, "v1", make)
        assert (a.count(), b.count(), len(built)) == (1, 1, want)
    files.open_index(spark, path, "v2", make)
    assert len(built) == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [("m", "e1", "correct", "t1", 1), ("m", "e1", "incorrect", "t3", 2), ("m", "e1", "correct", "t2", 3), ("m", "e2", "correct", None, 4)]
    df = spark.createDataFrame(rows, "map_id string, edge_id string, verdict string, ts string, seq long")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = logs.run_all(spark, logs.latest_verdicts(src), "verdicts", "update", str(tmp_path / "cp"))
    best = {(r.map_id, r.edge_id): r.verdict for r in out.orderBy("ts", "seq").collect()}
    assert best == {(r.map_id, r.edge_id): r.verdict for r in evaluate.latest_wins(df, ["map_id", "edge_id"]).collect()}


def test_long_cycles_and_deep_layers(spark):
    ring = [("s", f"n{i}", f"n{(i + 1) % 90}") for i in range(90)] + [("s", "n3", "up"), ("s", "down", "n4"), ("s", "x", "y"), ("t", "z", "z"), ("t", "a", "b")]
    r = spark.createDataFrame(ring, "session string, child string, parent string")
    assert {(x.session, x.id) for x in graph.cycle_members(r).collect()} == {("s", f"n{i}") for i in range(90)} | {("t", "z")}
    line = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}") for i in range(300)] + [("s", "n0", "n300")], "session string, from string, to string")
    assert {x.id: x.layer for x in graph.longest_path_layers(line).collect()} == {f"n{i}": i for i in range(301)}
    assert graph.cycle_members(line.withColumnsRenamed({"from": "child", "to": "parent"})).count() == 0


def test_sidecars_keep_what_they_do_not_know(spark, tmp_path):
    import json

    from weftline.sources import files

    (tmp_path / "layers_a.json").write_text('{"zones": [1], "claims": "no list", "future": {"x": [2]}, "documents": 3, "stats": {"n": 1}}')
    (tmp_path / "layers_b.json").write_text("{broken")
    (tmp_path / "layers_no good.json").write_text("{}")
    docs = files.read_sidecars(spark, str(tmp_path))
    got = {r.session: json.loads(r.doc) for r in docs.collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["zones"] == [1] and got["a"]["claims"] == [] and got["a"]["future"] == {"x": [2]} and "documents" not in got["a"] and got["a"]["stats"] == {"n": 1}
    assert got["b"] == {"version": 1, "session": "b", "stats": {}, "zones": [], "claims": [], "arguments": [], "refutes": []}
    files.write_sidecars(docs, str(tmp_path / "out"))
    back = {r.session: json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert back == got


def test_reports_are_saved_by_session(spark, tmp_path):
    g = spark.createDataFrame([("s", "g1", "structural", 0.75, "degree=0", 2), ("s", "g2", "causal", 0.5, None, 1), ("t", "g3", "causal", 0.45, "x", 1)], "session string, gap_id string, gap_type string, confidence double, signal string, turn int")
    gaps.save_report(g, str(tmp_path / "r"), "Gaps")
    assert spark.read.json(str(tmp_path / "r/json")).count() == 3
    text = next((tmp_path / "r/markdown/session=s").glob("part-*")).read_text()
    assert text.startswith("# Gaps\n\n- **g2** (causal, 0.5): \n- **g1** (structural, 0.75): degree=0\n")
    evaluate.save_evaluation(spark.createDataFrame([(0.5,)], "rate double"), str(tmp_path / "e"), "2024-01-01")
    evaluate.save_evaluation(spark.createDataFrame([(0.7,)], "rate double"), str(tmp_path / "e"), "2024-01-02")
    assert sorted(r.rate for r in spark.read.json(str(tmp_path / "e")).collect()) == [0.5, 0.7]
    before = spark.createDataFrame([("s", "1", ["k", "x"]), ("s", "2", ["x"])], "session string, id string, claim_refs array<string>")
    results = spark.createDataFrame([("s", "1", ("rejected",))], "session string, id string, validation struct<status:string>")
    claims = spark.createDataFrame([("s", "x", ("rejected",)), ("s", "k", ("validated",))], "session string, claim_id string, validation struct<status:string>")
    after = layers.apply_validation(before, results, claims)
    assert tuple(layers.validation_counts(before, after, results).first()) == ("s", 1, 1, 2)
