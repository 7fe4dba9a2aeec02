"""A stored trigram index: postings and rows in folders by hash, candidates by intersection, and a check of the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.containment import _pieces
from ..operators import corpus

SIZE, BUCKETS = 3, 32
#: Parts of a bucket's postings while they are written, so that a frequent trigram is not one task's work.
SALT = 4
#: Candidates are broadcast up to this number.
BROADCAST_ROWS = 1_000_000


def build(rows: DataFrame, text: Column, path: str, buckets: int = BUCKETS) -> None:
    """Writes ``rows`` by hash of the text, and (gram, text) by hash of the gram, sorted by gram so that row groups can be skipped.

    A text is posted once, however many rows have it.
    """
    keyed = rows.withColumn("_text", text).withColumn("_id", F.xxhash64("_text")).withColumn("_part", F.pmod("_id", F.lit(buckets)).cast("int"))
    keyed.write.mode("overwrite").partitionBy("_part").option("compression", "zstd").parquet(f"{path}/rows")
    _post(keyed.sparkSession.read.schema(keyed.schema).parquet(f"{path}/rows").select("_text", "_id", "_part").distinct(), path, buckets)


def _post(texts: DataFrame, path: str, buckets: int) -> None:
    """Writes the postings of distinct texts (_text, _id, _part)."""
    posts = texts.select(F.explode(_pieces(F.col("_text"), SIZE)).alias("gram"), "_id", "_part")
    posts = posts.withColumn("_bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    posts = posts.repartition(F.col("_bucket"), F.pmod("_id", F.lit(SALT))).sortWithinPartitions("_bucket", "gram")
    posts.write.mode("overwrite").partitionBy("_bucket").option("compression", "zstd").parquet(f"{path}/posts")
    texts.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/meta")


def build_pair(rows: DataFrame, first: Column, second: Column, path: str, buckets: int = BUCKETS) -> None:
    """An index of two texts of a row, each posted by itself, so postings grow with the texts and not with their pairs. Rows lie by hash of the second."""
    keyed = rows.withColumns({"_first": F.xxhash64(first), "_second": F.xxhash64(second)}).withColumn("_part", F.pmod("_second", F.lit(buckets)).cast("int"))
    keyed.sortWithinPartitions("_part", "_second").write.mode("overwrite").partitionBy("_part").option("compression", "zstd").parquet(f"{path}/rows")
    stored = keyed.sparkSession.read.schema(keyed.schema).parquet(f"{path}/rows")
    for name, text, part in (("first", first, F.lit(0)), ("second", second, F.col("_part"))):
        texts = stored.select(text.alias("_text"), F.col(f"_{name}").alias("_id"), part.alias("_part")).where("_text is not null").distinct()
        _post(texts, f"{path}/{name}", buckets)


def find_pair(spark: SparkSession, path: str, first: Column, second: Column, query: str) -> DataFrame:
    """The rows one of whose two texts, put together by a line break, contains ``query``; one that is short or has a line break is a scan.

    For hits of the second text only their folders are read.
    """
    rows = spark.read.parquet(f"{path}/rows")
    if len(query) >= SIZE and "\n" not in query:
        one, two = (postings(spark, f"{path}/{name}", query) for name in ("first", "second"))
        parts = [r._part for r in two.select("_part").distinct().collect()]  # no more than there are folders
        one, two = (F.broadcast(x) if x.count() <= BROADCAST_ROWS else x for x in (one.select(F.col("_id").alias("_first")), two.select(F.col("_id").alias("_second"))))
        by_first = rows.join(one, "_first", "left_semi").join(two, "_second", "left_anti")
        rows = rows.where(F.col("_part").isin(parts)).join(two, "_second", "left_semi")
        rows = rows if one.isEmpty() else rows.unionByName(by_first.select(rows.columns))
    return rows.where(F.concat_ws("\n", first, second).contains(query)).drop("_first", "_second", "_part")


def postings(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(_part, _id) of the texts that have all trigrams of ``query``; only the folders of these trigrams are read."""
    grams = sorted({query[i : i + SIZE] for i in range(len(query) - SIZE + 1)})
    buckets = spark.read.parquet(f"{path}/meta").first().buckets
    at = spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("b")).distinct()
    posts = spark.read.parquet(f"{path}/posts").where(F.col("_bucket").isin([r.b for r in at.collect()]) & F.col("gram").isin(grams))  # no more than the query has
    return posts.groupBy("_part", "_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).drop("n")


def find(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows whose text contains ``query``; a query below three characters, which has no trigram, is a scan."""
    rows = spark.read.parquet(f"{path}/rows")
    if len(query) >= SIZE:
        hits = postings(spark, path, query)
        parts = [r._part for r in hits.select("_part").distinct().collect()]  # no more than there are folders
        hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
        rows = rows.where(F.col("_part").isin(parts)).join(hits, ["_part", "_id"], "left_semi")
    return rows.where(F.col("_text").contains(query)).drop("_text", "_id", "_part")


def build_search(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The two indexes of :func:`corpus.search`: normalised labels of nodes, labels and evidence of edges. Each frame is read once."""
    build(nodes, F.col("label_norm"), f"{path}/nodes")
    build_pair(edges, *_edge(), f"{path}/edges")


def _edge() -> tuple[Column, Column]:
    """The texts of an edge that are searched."""
    return F.lower("label"), F.lower("evidence")


def search(spark: SparkSession, path: str, query: str, limit: int = 8) -> DataFrame:
    """As :func:`corpus.search`, over the rows that the index finds."""
    import unicodedata

    q = unicodedata.normalize("NFKC", query).strip().casefold()
    return corpus.search(find(spark, f"{path}/nodes", q), find_pair(spark, f"{path}/edges", *_edge(), q), query, limit)
