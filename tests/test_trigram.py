"""The trigram index against a scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.sources import trigram


def test_find_equals_the_scan_and_reads_fewer_files(spark, tmp_path):
    labels = [f"{a} {b}{k % 7}" for k, (a, b) in enumerate((a, b) for a in ("Alpha", "beta", "50%_x", "ＡＩ", "機械学習", "") for b in ("gamma", "delta", "beta", "データ同化", "zz"))] * 3
    df = spark.createDataFrame([(i, x, x.lower()) for i, x in enumerate(labels)] + [(1, labels[1], labels[1].lower())], "id long, label string, norm string")
    path = str(tmp_path / "index")
    trigram.build(df, F.col("norm"), path, 16)
    for q in ("alp", "a", "", "ta", "beta", "a delta", "50%", "%_x", "機械学習", "学習 データ", "nothing here", "aaa", "alpha gamma0", "a" * 50):
        want = sorted(map(str, df.where(F.col("norm").contains(q)).collect()))
        assert sorted(map(str, trigram.find(spark, path, q).collect())) == want, q
    all_files = len(spark.read.parquet(f"{path}/posts").inputFiles())
    plan = trigram.postings(spark, path, "機械学習")
    plan.collect()
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PushedFilters: [" in scan and "_bucket" in scan
    buckets = plan.sparkSession.read.parquet(f"{path}/posts").where("gram in ('機械学', '械学習')").select("_bucket").distinct().collect()
    read = [f for f in spark.read.parquet(f"{path}/posts").inputFiles() if any(f"_bucket={b._bucket}/" in f for b in buckets)]
    assert 0 < len(read) < all_files / 2
