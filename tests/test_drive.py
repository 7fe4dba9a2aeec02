"""The drive source: pages are read by tasks, and filters reach the provider."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

from weftline.sources import drive, files

ARGS = {"name": "id", "modified": "at", "text": "body"}


def test_pages_and_pushed_filters(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(days=i), f"text {i}" if i % 9 else " ") for i in range(60)]
    table = pa.table({"id": [r[0] for r in rows], "at": pa.array([r[1] for r in rows], pa.timestamp("us")), "body": [r[2] for r in rows]})
    path = str(tmp_path / "t.parquet")
    pq.write_table(table, path, row_group_size=10)
    docs = files.scan_cloud(spark, "weftline.plans.providers:TableDrive", path=path, **ARGS)
    assert docs.rdd.getNumPartitions() == 6
    assert {(r.name, r.modified, r.text) for r in docs.collect()} == {(str(i), m, t) for i, m, t in rows if t.strip()}
    late = files.scan_cloud(spark, "weftline.plans.providers:TableDrive", "2024-02-05 00:00:00", path=path, **ARGS)
    assert late.rdd.getNumPartitions() == 3 and {r.name for r in late.collect()} == {str(i) for i, m, t in rows if m >= dt.datetime(2024, 2, 5) and t.strip()}
    one = drive.read_drive(spark, "weftline.plans.providers:TableDrive", path=path, **ARGS).where("name = '17' and modified > timestamp'2024-01-05 00:00:00'")
    assert [r.text for r in one.collect()] == ["text 17"]
    assert files.scan_cloud(spark).count() == 0 and files.scan_cloud(spark, "weftline.plans.providers:TableDrive", "2030-01-01 00:00:00", path=path, **ARGS).count() == 0
