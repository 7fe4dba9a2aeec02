"""Operator 12 against a plain computation."""

from __future__ import annotations

import hashlib
import unicodedata

import pytest
import xxhash

from weftline.llm import fingerprint as fp

TEXTS = [
    "Ａb  C", "ab c", None, "", " \t\n", "Straße!", "STRASSE!", "été", "ÉTÉ", "ﬁne day", "fine day", "ΑΣ", "ας", "İx", "i̇x", "abc", "abcd", "abcde",
    "long " * 30_000, "LONG  " * 30_000, "́ͅa", "a\x1cb", "A b",
]


def folded(t: str | None) -> str:
    """By the definition of the compatibility caseless match, then white space."""
    t = unicodedata.normalize("NFD", t or "").casefold()
    t = unicodedata.normalize("NFKD", t).casefold()
    return " ".join(unicodedata.normalize("NFKC", t).split())


def edited(t: str | None, n: str | None) -> str:
    t, n = t or "", n or ""
    k = len(t) // 4
    return t[: len(t) - k] + n[:k]


def check(rows, got):
    """``rows`` (id, text) in order, each with its result."""
    for (i, t), (_, following), r in zip(rows, rows[1:] + rows[:1], got, strict=True):
        e = edited(t, following)
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t or ""), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == xxhash.xxh3_128_hexdigest(folded(t).encode()) and r.edited_fingerprint == xxhash.xxh3_128_hexdigest(folded(e).encode())
        assert (r.near_edited, r.near_next) == (float(folded(t) == folded(e)), float(folded(t) == folded(following)))


def test_folding_is_stable():
    for t in TEXTS:
        assert fp.canonical(t or "").decode() == folded(t) == fp.canonical(fp.canonical(t or "").decode()).decode()


@pytest.mark.parametrize("parts", ["1", "6"])
def test_query_against_plain_computation(spark, parts):
    rows = [(3 * i, TEXTS[(i * 7) % len(TEXTS)]) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fp.op12(spark, df).orderBy("doc_id").collect()
        assert not fp.op12(spark, df.where("false")).collect()
        (one,) = fp.op12(spark, df.where("doc_id = 0")).collect()
        assert one.near_next == 1.0 and one.doc_id == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    check(rows, got)


def test_query_over_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    got = fp.op12(spark, df).orderBy("doc_id").collect()
    check(rows, got)
    assert len({r.fingerprint for r in got}) == len({folded(t) for _, t in rows}) < len(rows)


def test_ids_that_are_null_or_repeat(spark):
    rows = [(None, "one two three"), (None, "one two three"), (None, None), (5, "four five six"), (5, "seven eight"), (5, "seven eight")]
    got = fp.op12(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and sum(r.doc_id is None for r in got) == 3
    hashes = {t: xxhash.xxh3_128_hexdigest(folded(t).encode()) for _, t in rows}
    assert sorted(r.fingerprint for r in got) == sorted(hashes[t] for _, t in rows)
    assert sum(r.near_next for r in got) == 2.0  # equal rows are neighbours


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_unequal_texts_of_one_bucket_are_told_apart(spark, bits):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"text {i % 5} " * (i % 4 + 1)) for i in range(80)]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(4)
    name = {r.doc_id: r.fingerprint for r in fp.fingerprinted(df, bits=bits).collect()}
    assert len(name) == 80
    for i, t in rows:
        for j, u in rows:
            assert (name[i] == name[j]) == (folded(t) == folded(u))
    got = {r.id: r for r in fp.edited_fingerprints(df, bits=bits).collect()}
    said: dict[str, set[str]] = {}
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        for f, text in ((got[i].fingerprint, t), (got[i].edited_fingerprint, edited(t, following)), (got[i].next_fingerprint, following)):
            said.setdefault(f, set()).add(folded(text))
    every = [folded(x) for (_, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True) for x in (t, edited(t, n))]
    assert all(len(s) == 1 for s in said.values()) and len(said) == len(set(every))


def test_general_form_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([("a", "X  y", 1), ("a", "X  y", 1), (None, "x Y", 2), ("b", None, None)], "id string, body string, n int")
    got = fp.fingerprinted(df, "body")
    assert got.columns == ["id", "body", "n", "fingerprint"] and got.count() == 4
    assert len({r.fingerprint for r in got.where("body is not null").collect()}) == 1
    assert not fp.fingerprinted(df.where("false"), "body").collect()
