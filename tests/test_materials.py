"""Neighbourhoods of many questions against one question and one session after another."""

from __future__ import annotations

import random

from weftline.operators import corpus


def one_after_another(nodes, edges, seeds, hops, most):
    """Concepts in order and whether something was left out, with a budget that goes on from session to session."""
    sessions = list(dict.fromkeys(s for _, s, _ in sorted(seeds)))
    left, out, cut = most, [], False
    for s in sessions:
        front = {i for _, t, i in seeds if t == s and (s, i) in nodes}
        seen = dict.fromkeys(front, 0)
        for h in range(1, hops + 1):
            front = {b for x, y in edges.get(s, ()) for a, b in ((x, y), (y, x)) if a in front and b not in seen and x != y and (s, b) in nodes}
            seen |= dict.fromkeys(front, h)
        order = sorted(seen, key=lambda i: (seen[i], i))
        cut = cut or len(order) > left
        out += [(s, i, seen[i]) for i in order[: max(left, 0)]]
        left -= len(order[: max(left, 0)])
    return out, cut


def test_materials_against_one_question_after_another(spark):
    r = random.Random(8)
    nodes = {(f"s{k}", f"n{i:02d}") for k in range(4) for i in range(30) if r.random() < 0.9}
    edges = {f"s{k}": [(f"n{r.randrange(30):02d}", f"n{r.randrange(30):02d}") for _ in range(30)] for k in range(4)}
    questions = {q: [(p, f"s{r.randrange(4)}", f"n{r.randrange(32):02d}") for p in range(1, r.randrange(2, 9))] for q in range(25)}
    questions = {q: list({(s, i): (p, s, i) for p, s, i in reversed(v)}.values()) for q, v in questions.items()}
    n = spark.createDataFrame(sorted(nodes), "session string, id string")
    e = spark.createDataFrame([(s, f"e{k:02d}", a, b) for s, v in edges.items() for k, (a, b) in enumerate(v)], "session string, id string, `from` string, `to` string")
    sd = spark.createDataFrame([(q, p, s, i) for q, v in questions.items() for p, s, i in v], "question long, place long, session string, id string")
    for most in (6, 11, 1000):
        concepts, relations = corpus.local_materials(n, e, sd, 2, most)
        got, rel = {}, {}
        for c in concepts.orderBy("question", "place").collect():
            got.setdefault(c.question, ([], c.truncated))[0].append((c.session, c.id, c.hop))
            assert c.seed == (c.hop == 0)
        for x in relations.collect():
            rel.setdefault(x.question, set()).add((x.session, x.id))
        for q, v in questions.items():
            want, truncated = one_after_another(nodes, edges, v, 2, most)
            assert got.get(q, ([], truncated)) == (want, truncated), (q, most)
            have = {(s, i) for s, i, _ in want}
            assert rel.get(q, set()) == {(s, f"e{k:02d}") for s, es in edges.items() for k, (a, b) in enumerate(es) if a != b and (s, a) in have and (s, b) in have}
    one, _ = corpus.local_material(n, e, n.where("id = 'n01'"), 1, 5)
    assert one.count() == 5 and one.columns == ["place", "session", "id", "hop", "seed", "truncated"]
    assert not corpus.local_materials(n, e, sd.where("false"))[0].collect()


def test_global_materials(spark):
    members = [("c1", "ai"), ("c1", "machine learning"), ("c1", "deep learning"), ("c2", "satellite"), ("c2", "ai policy"), ("c3", "a"), ("c4", "x"), ("c4", "y"), ("c4", "z"), ("c4", "w")]
    m = spark.createDataFrame([*members, ("c3", None)], "community string, member string")
    questions = spark.createDataFrame([(1,), (2,), (3,)], "question int")
    terms = spark.createDataFrame([(1, "learning"), (1, "ai"), (2, "satellites"), (2, ""), (2, None)], "question int, term string")
    asked = {1: ["learning", "ai"], 2: ["satellites"], 3: []}
    sets = {c: sorted(x for d, x in members if d == c) for c, _ in members}
    got = corpus.communities_of_questions(m, questions, terms, 3).orderBy("question", "rank").collect()
    for q, words in asked.items():
        score = {c: sum(t in x or x in t for x in s for t in words) for c, s in sets.items()}
        want = sorted(sets, key=lambda c: (-score[c], -len(sets[c]), c))[:3]
        assert [(r.rank, r.community, r.score, r.size) for r in got if r.question == q] == [(i + 1, c, score[c], len(sets[c])) for i, c in enumerate(want)]
    import hashlib

    mark = lambda s: hashlib.sha256("\n".join(sorted(s)).encode()).hexdigest()[:16]
    cached = spark.createDataFrame([(mark(sets["c1"]), "about learning"), (mark(sets["c2"][:1]), "old"), (mark(sets["c4"]), "")], "fingerprint string, summary string")
    rows = {(r.question, r.community): r for r in corpus.global_materials(m, questions, terms, cached, spark.createDataFrame([("ai", "AI")], "member string, label string")).collect()}
    assert rows[1, "c1"].summary == "about learning" and rows[1, "c1"].cached and rows[1, "c1"].title == "AI・deep learning ほか 1 概念"
    assert rows[2, "c2"].summary is None and not rows[3, "c4"].cached and len(rows) == 9
    assert not corpus.global_materials(m.where("false"), questions, terms, cached).collect()
