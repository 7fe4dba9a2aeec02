"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import random

import corpus_pipeline
from test_llm_operators import DOC, brute_components, brute_quality, words

from weftline.llm import packing, secretscan


def test_pipeline_equals_brute_force(spark, tmp_path):
    random.seed(11)
    items = [words(25), words(40)]
    base = [words(random.randint(30, 200)) for _ in range(60)]
    texts = [None, "", words(10), f"{words(9)}\n" * 6] + base
    for t in base[:20]:
        w = t.split()
        w[random.randrange(len(w))] = "changed"
        texts += [" ".join(w), t]
    texts += [f"{words(30)} {random.choice(items)} {words(30)}" for _ in range(8)]
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts += [f'{words(40)} token = "{secret}" {words(40)}' for _ in range(5)] + ["y " * 20000 + words(60000)]
    random.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {i: t for i, t in enumerate(texts) if not brute_quality(t)[5]}
    keys = sorted(left)
    left = {keys[i]: left[keys[i]] for i, _, c in brute_components([left[k] for k in keys], 5, 80, 100) if c == i}
    left = {i: t for i, t in left.items() if not any(x in t for x in items)}
    left = {i: secretscan.redact(t, secretscan.scan(t)) for i, t in left.items()}
    assert not any(secret in t for t in left.values()) and any("[SECRET]" in t for t in left.values())

    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
        assert r.end - r.start <= r.capacity and r.capacity in packing.CAPACITIES
    assert set(got) == set(left)
    for i, spans in got.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len(left[i].encode()) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "secret_scan", "best_fit_packing"]
