"""Helpers shared by the operators: scratch space, batches, whole-table reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Rows are handed on to Python kernels in slices of so many bytes of text at most (one row at least).
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_weftline_dir", None) or tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext._weftline_dir = base
        spark.sparkContext.setCheckpointDir(base)
    return base


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes them all, as does the end of a ``with`` block."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.drop()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # Small row groups: a writing task holds one, beside its Python worker.
        df.write.option("compression", "snappy").option("parquet.block.size", 32 << 20).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """A small result cut from its lineage by a checkpoint in the shared folder.

    Spark removes the files with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set, else they stay.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_BYTES of the text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text_col)
        col = batch.column(at)
        if not pa.types.is_large_binary(col.type) and not pa.types.is_binary(col.type):
            col = col.cast(pa.binary())
        sizes = pa.compute.binary_length(col).fill_null(0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def per_text(df: DataFrame, cols: list[str], text_col: str, schema: str, kernel: Callable[[dict], dict]) -> DataFrame:
    """``kernel`` over slices of ``cols`` of ``df`` as Python lists (text as bytes-free str); one pass, no shuffle.

    ``kernel`` gets a dict of lists and returns a dict of lists or arrays in the order of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out_schema)

    def run(batches):
        for batch in slices(batches, text_col):
            out = kernel({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for f, v in zip(arrow, out.values(), strict=True)], schema=arrow
            )

    return df.select(*cols).mapInArrow(run, out_schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


