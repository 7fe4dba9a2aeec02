"""The containment join against a comparison of all with all."""

from __future__ import annotations

import random

import pytest

from weftline.functions.containment import containing
from weftline.plans import registry


@pytest.mark.parametrize("by", [(), ("s",)])
def test_containing_against_all_pairs(spark, by):
    r = random.Random(1)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    texts = [(r.choice("xy"), word(r.choice([0, 1, 3, 9, 60]), "abcé ")) for _ in range(120)] + [("x", None), ("x", "abcabc" * 3000)]
    terms = [(r.choice("xy"), word(r.choice([0, 1, 2, 3, 4, 5, 7]), "abcé ")) for _ in range(200)] + [("x", None), ("x", "abcabc" * 2000), ("y", "zzzzzz")]
    a, b = spark.createDataFrame(texts, "s string, text string"), spark.createDataFrame(terms, "s string, term string")
    got = [tuple(x) for x in containing(a, b, by).collect()]
    want = {(*((s,) if by else ()), t, w) for s, t in texts for u, w in terms if t is not None and w and w in t and (not by or s == u)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert not containing(a, b.where("false"), by).collect()


@pytest.mark.parametrize("name", ["question_terms", "ranked_communities", "zones_of_texts", "resolved_documents"])
def test_no_nested_loops(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
