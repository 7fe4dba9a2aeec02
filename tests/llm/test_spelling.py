"""Operator 11 against brute force over all pairs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import spelling
from weftline.llm.common import Scratch


def at_distance_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(vocab: dict[str, int]) -> set[tuple]:
    form, count = {}, {}
    for w, n in vocab.items():
        near = [x for x in vocab if at_distance_one(w, x)]
        best = min(near, key=lambda x: (-vocab[x], x), default=None)
        form[w], count[w] = best if best and vocab[best] >= 2 * n else None, len(near)
    out = set()
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, count[w], vocab.get(form[w])))
    return out


def rows(df) -> list[tuple]:
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", max_size=6), max_size=40))
def test_trie_pairs_are_all_pairs_once(words):
    words, got = sorted(words), Counter()
    spelling.trie_pairs(words, lambda i, j: got.update([(min(i, j), max(i, j))]))
    want = {(i, j) for j in range(len(words)) for i in range(j) if at_distance_one(words[i], words[j])}
    assert set(got) == want and set(got.values()) <= {1}


def test_trie_pairs_of_long_words():
    long = "x" * 60_000
    words = sorted([long, long + "y", "x" * 59_999, "z" + long])
    got = set()
    spelling.trie_pairs(words, lambda i, j: got.add((min(i, j), max(i, j))))
    assert got == {(i, j) for j in range(4) for i in range(j) if words[i] == long or words[j] == long}


@pytest.mark.parametrize("task_chars", [20, 300, 10**6])
def test_variants_over_ranges_against_brute_force(spark, task_chars):
    # Words that part early, late, and at the borders of ranges.
    words = {f"{a}{b}{c}" for a in ("", "q", "w", "qu") for b in ("house", "mouse", "mousse", "ourse", "éouse", "aaaa", "aaaaa", "aaaaaa") for c in ("", "s", "d", "ss")}
    vocab = {w: zlib.crc32(w.encode()) % 23 + 3 for w in words}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    got = rows(spelling.variants(df, task_chars=task_chars))
    assert len(got) == len(vocab) and set(got) == brute(vocab)


def test_ranges_share_a_spine(spark):
    vocab = {f"{a}aaa{b}": 3 for a in "abcdefgh" for b in "abcdefgh"}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    with Scratch(spark, "test") as tmp:
        local = tmp.write(spelling._near_in_ranges(df.repartitionByRange(5, "word").sortWithinPartitions("word")), "x")
        spine = spelling._spine(local)
        assert "" in spine and local.select("part").distinct().count() > 2
        across = spelling._near_across(local, spine).groupBy("word").sum("n_near").collect()
        per = {r.word: r.n_near for r in local.collect()}
        for w, n in across:
            per[w] += n
        assert per == {w: sum(at_distance_one(w, x) for x in vocab) for w in vocab}


def brute_counts(docs) -> dict[str, int]:
    out: Counter = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def test_query_on_texts_of_all_kinds(spark):
    bases = ["Kitchen kitchén KITCHEN kitchens ÉCOLE école naïve×word don't x1kitchen", "", None, "  \n", "kitchinĀkitchin kitchen-kitchens", "z" * 30_000 + " été"]
    docs = [(i if i % 7 else None, bases[i % len(bases)]) for i in range(400)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = rows(spelling.op11(spark, df))
    assert len(got) == len({r[0] for r in got}) and set(got) == brute(brute_counts(docs)) and len(got) > 8
    assert any(r[0] == "z" * 30_000 for r in got)
    assert not spelling.op11(spark, df.where("false")).collect()
    assert sorted(rows(spelling.op11(spark, df.repartition(5)))) == sorted(got, key=str) or set(rows(spelling.op11(spark, df.repartition(5)))) == set(got)


def test_query_over_the_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocab = brute_counts([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = rows(spelling.op11(spark, df))
    # All pairs by deletion: words that agree without one character, or with one against none.
    holes: dict[str, list[str]] = {}
    for w in vocab:
        for k in range(len(w)):
            holes.setdefault(w[:k] + w[k + 1 :], []).append(w)
    near: dict[str, set[str]] = {w: {x for k in range(len(w)) for x in [*holes[w[:k] + w[k + 1 :]], w[:k] + w[k + 1 :]] if x in vocab and at_distance_one(w, x)} for w in vocab}
    for w in vocab:
        for x in near[w].copy():
            near[x].add(w)
    assert {(r[0], r[3], r[4]) for r in got} == {(w, n, len(near[w])) for w, n in vocab.items()}
    best = {w: min(near[w], key=lambda x: (-vocab[x], x), default=None) for w in vocab}
    assert {r[0]: r[1] for r in got} == {w: b if b and vocab[b] >= 2 * vocab[w] else None for w, b in best.items()}
