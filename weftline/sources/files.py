"""Sources and sinks: folders of documents, session files, JSON-lines logs, Parquet indexes."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import drive
from ..functions.containment import containing
from ..functions.text import extract_text, normalize_label

EXTENSIONS = ("pdf", "txt", "md", "docx")
DOC_CHARS, BUDGET_CHARS = 15_000, 48_000
SESSION_NAME = r"^[0-9A-Za-z_\-]{1,64}$"


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


def cut(df: DataFrame) -> DataFrame:
    """The frame computed and cut from its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession, rows: float, each: int = 500_000) -> int:
    """How many partitions ``rows`` take so that a task has ``each`` of them: stated, since Spark joins small partitions by their bytes, not by their work."""
    cores = min(spark.sparkContext.defaultParallelism, math.ceil(rows * 10 / each))
    return max(1, cores, math.ceil(rows / each))


class Steps:
    """Tables of a loop, written as Parquet to the shared folder: lineage ends, and each step knows the true sizes of what it reads.

    The end of a ``with`` block removes them all, so what leaves the block must be cut first.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/weftline-steps/{uuid.uuid4().hex}"
        self.count = 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def scan_folder(spark: SparkSession, path: str, since: str | None = None, most: int = DOC_CHARS) -> DataFrame:
    """(name, source, modified, text) of the documents below ``path``; extension and time are tested before a file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
    if since:
        reader = reader.option("modifiedAfter", since)
    name = F.element_at(F.split("path", "/"), -1)
    out = reader.load(path).select(name.alias("name"), F.lit("local").alias("source"), F.col("modificationTime").alias("modified"), F.left(extract_text(name, F.col("content")), F.lit(most)).alias("text"))
    return out.where(F.trim("text") != "")


def scan_cloud(spark: SparkSession, provider: str | None = None, since: str | None = None, most: int = DOC_CHARS, **options: str) -> DataFrame:
    """Documents of a cloud drive, read by executors; ``provider`` is ``module:Class`` (see :mod:`.drive`); none without a provider."""
    if not provider:
        return spark.createDataFrame([], drive.SCHEMA)
    return drive.read_drive(spark, provider, since, **options).withColumn("text", F.left("text", F.lit(most))).where(F.trim("text") != "")


def within_budget(docs: DataFrame, budget: int = BUDGET_CHARS, partition: list[str] | None = None) -> DataFrame:
    """Newest first until ``budget`` characters are used; the last document that still fits in part is cut."""
    w = Window.partitionBy(*(partition or [F.lit(1)])).orderBy(F.col("modified").desc(), "name")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = docs.withColumn("offset", before).where(F.col("offset") < budget)
    return out.withColumn("text", F.left("text", (F.lit(budget) - F.col("offset")).cast("int")))


def bundle(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One prompt text of the documents in order of their offsets."""
    part = F.concat(F.lit("### "), F.col("name"), F.lit("\n"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("offset", "name", part.alias("part"))))
    return docs.groupBy(*(by or [])).agg(F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n").alias("bundle"))


def session_names(spark: SparkSession, path: str) -> DataFrame:
    """Sessions that have a graph file, newest first; files outside the naming rule are ignored."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "kg_session_*.json").load(path).select("path")
    name = F.regexp_extract("path", r"kg_session_(.*)\.json$", 1)
    return files.select(name.alias("session")).where(F.col("session").rlike(SESSION_NAME)).orderBy(F.desc("session"))


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, communities) of all session files below ``path``."""

    def strip(ddl: str) -> str:
        return ddl.removeprefix("session string, ")

    struct = f"nodes array<struct<{_fields(strip(S.NODE))}>>, edges array<struct<{_fields(strip(S.EDGE))}>>, communities array<struct<{_fields(strip(S.COMMUNITY))}>>"
    raw = spark.read.schema(struct).option("multiLine", True).option("pathGlobFilter", "kg_session_*.json").json(path)
    raw = raw.withColumn("session", F.regexp_extract(F.col("_metadata.file_name"), r"kg_session_(.*)\.json$", 1)).where(F.col("session").rlike(SESSION_NAME))
    return tuple(raw.select("session", F.inline(c)) for c in ("nodes", "edges", "communities"))


def _fields(ddl: str) -> str:
    """``name type`` columns as fields of a struct."""
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return ",".join(":".join(p.split(" ", 1)) for p in [*out, part.strip()])


def read_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of a JSON-lines log in order (``seq``); blank, comment and broken lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("seq"))
    lines = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("//"))
    names = [c.split(":", 1)[0].strip("`") for c in _split_top(_fields(ddl))]
    row = F.from_json("value", f"{ddl}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = lines.withColumn("r", row).where("r is not null and r._corrupt is null")
    return out.select(*(F.col(f"r.`{n}`").alias(n) for n in names), "seq")


def _split_top(fields: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def gold_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relation judgements: the rows of the gold folder that carry neither a gap id nor a decision."""
    return read_log(spark, path, f"{S.RELATION_GOLD}, gap_id string, decision string").where("gap_id is null and decision is null").drop("gap_id", "decision")


def gold_gaps(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, S.GAP_GOLD).where("gap_id is not null or decision is not null")


def last_rejection(rejections: DataFrame) -> DataFrame:
    """The last row per (session, target)."""
    return rejections.groupBy("session", "target_id").agg(F.max_by(F.struct("kind", "text", "combined", "reason", "seq"), "seq").alias("r")).select("session", "target_id", "r.*")


def history(rows: DataFrame, limit: int = 50) -> DataFrame:
    return rows.orderBy(F.desc("seq")).limit(limit)


def append(df: DataFrame, path: str) -> None:
    """Append sink of a JSON-lines log."""
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replaces a Parquet table at once by Spark's commit protocol."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def fingerprint(files: DataFrame, version: str = "v1") -> DataFrame:
    """One row: the version and 32 digits of SHA-256 over the sorted (name, size, modified) of the input files."""
    line = F.concat_ws("|", "name", "size", "modified")
    return files.agg(F.concat(F.lit(f"{version}-"), F.left(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256), F.lit(32))).alias("fingerprint"))


def build_index(corpus_nodes: DataFrame, corpus_edges: DataFrame, path: str, print_: str) -> None:
    """Flat search tables partitioned by session: a row per (label, source) and per (edge, source), and the inputs' fingerprint."""
    n = corpus_nodes.select("label_norm", "label", "onto_class", "importance", F.explode("sources").alias("s")).select("*", "s.*").drop("s")
    e = corpus_edges.select("from_norm", "to_norm", "glyph", "label", "weight", F.explode("sources").alias("s")).select("*", "s.*").drop("s")
    overwrite(n, f"{path}/nodes", "session")
    overwrite(e, f"{path}/edges", "session")
    overwrite(n.sparkSession.createDataFrame([(print_, uuid.uuid4().hex)], "fingerprint string, build string"), f"{path}/meta")


def open_index(spark: SparkSession, path: str, print_: str, rebuild) -> tuple[DataFrame, DataFrame]:
    """The tables of the index, built anew by ``rebuild()`` if it is missing, stale or broken."""
    from pyspark.errors import AnalysisException

    try:
        stale = spark.read.schema("fingerprint string, build string").parquet(f"{path}/meta").where(F.col("fingerprint") == print_).isEmpty()
    except AnalysisException:
        stale = True
    if stale:
        rebuild()
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def index_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("node_rows"), F.count_distinct("label_norm").alias("labels"), F.count_distinct("session").alias("sessions"))
    return n.join(edges.agg(F.count("*").alias("edge_rows")))


def importance_of(levels: DataFrame) -> DataFrame:
    """(session, id, importance): of the most detailed level that has the node; aggregates are skipped."""
    order = F.when(F.col("level") == "detailed", 0).when(F.col("level") == "standard", 1).when(F.col("level") == "overview", 2).otherwise(3)
    return levels.where("not coalesce(is_aggregate, false)").groupBy("session", "id").agg(F.min_by("importance", order).alias("importance"))


def resolve_documents(ids: DataFrame, names: DataFrame) -> DataFrame:
    """(document_id, name): exact name, else base name, else stem, else the only name that contains the id; null if none."""
    base = lambda c: F.element_at(F.split(c, r"[/\\]"), -1)
    stem = lambda c: F.regexp_replace(base(c), r"\.[^.]*$", "")
    i = ids.select("document_id").distinct()
    n = names.select("name").distinct()
    found = []
    for rank, f in enumerate((lambda c: c, base, stem)):
        k = n.groupBy(F.lower(f(F.col("name"))).alias("k")).agg(F.min("name").alias("name"))
        found.append(i.withColumn("k", F.lower(f(F.col("document_id")))).join(k, "k").select("document_id", "name", F.lit(rank).alias("rank")))
    exact = found[0].unionByName(found[1]).unionByName(found[2])
    # Only what is left is compared by containment.
    rest = i.join(exact, "document_id", "left_anti").withColumn("term", F.lower("document_id"))
    low = n.withColumn("text", F.lower("name"))
    part = rest.join(containing(low, rest), "term").join(low, "text")
    part = part.groupBy("document_id").agg(F.count("*").alias("k"), F.min("name").alias("name")).where("k = 1").select("document_id", "name", F.lit(3).alias("rank"))
    best = exact.drop("k").unionByName(part).groupBy("document_id").agg(F.min_by("name", "rank").alias("name"))
    return i.join(best, "document_id", "left")


def document_roster(local: DataFrame, cited: DataFrame) -> DataFrame:
    """(label_norm, name, local): local documents and cited files, one row per normalised name, local ones first."""
    rows = local.select("name", F.lit(True).alias("local")).unionByName(cited.select("name", F.lit(False).alias("local")))
    rows = rows.withColumn("label_norm", normalize_label(F.col("name"))).where("label_norm <> ''")
    return rows.groupBy("label_norm").agg(F.min_by(F.struct("name", "local"), F.struct(~F.col("local"), "name")).alias("r")).select("label_norm", "r.*")


def document_ids(spans: DataFrame) -> DataFrame:
    """Distinct document ids in the order in which they first occur (``pos``)."""
    return spans.where("document_id is not null and document_id <> ''").groupBy("document_id").agg(F.min("pos").alias("pos")).orderBy("pos")


def sidecar_stats(zones: DataFrame, claims: DataFrame, arguments: DataFrame, refutes: DataFrame) -> DataFrame:
    """(session, zones, claims, validated, arguments, refutes)."""
    out = zones.groupBy("session").agg(F.count("*").alias("zones"))
    out = out.join(claims.groupBy("session").agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "validated").alias("validated")), "session", "full")
    out = out.join(arguments.groupBy("session").agg(F.count("*").alias("arguments")), "session", "full")
    out = out.join(refutes.groupBy("session").agg(F.count_if(F.col("verdict") != "none").alias("refutes")), "session", "full")
    return out.fillna(0)


def titles(rows: DataFrame) -> DataFrame:
    """(session, message): the latest message of every session."""
    return rows.where("session is not null").groupBy("session").agg(F.max_by("message", "seq").alias("message"))


def _age(at):
    """Whole minutes from ``created``; seconds have fractions, as those of ``epoch`` in SQL."""
    seconds = lambda t: F.unix_micros(t.cast("timestamp")) / 1e6
    return F.floor((seconds(at) - seconds(F.col("created"))) / 60)


def cache_lookup(requests: DataFrame, cache: DataFrame, ttl_minutes: int = 360) -> DataFrame:
    """Requests (key, at) with the newest cached entry (of equal times the greatest) whose age in whole minutes is within the time to live."""
    age = _age(F.col("at"))
    met = requests.join(cache, "key").withColumn("age_min", age).where((F.col("age_min") >= 0) & (F.col("age_min") <= ttl_minutes))
    best = met.groupBy("key", "at").agg(F.max(F.struct("created", "entry", "age_min")).alias("r")).select("key", "at", "r.*")
    return requests.join(best, ["key", "at"], "left")


def prune(cache: DataFrame, now, ttl_minutes: int = 360) -> DataFrame:
    return cache.where(_age(now) <= ttl_minutes)


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs at a restart: what was running or queued counts as interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin("running", "queued"), "interrupted").otherwise(F.col("status")))


#: Lists that a side-car always has.
SIDECAR_LISTS = ("zones", "claims", "arguments", "refutes")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(session, doc): side-cars below ``path`` as JSON text with all their lists; unknown keys stay, unreadable files are empty ones."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "layers_*.json").load(path)
    session = F.regexp_extract("path", r"layers_(.*)\.json$", 1)
    return raw.select(session.alias("session"), sidecar(session, F.col("content").cast("string")).alias("doc")).where(F.col("session").rlike(SESSION_NAME))


def sidecar(session, raw):
    """The JSON text of a side-car with its lists filled in, all other keys as they are."""

    @F.pandas_udf("string")
    def filled(sessions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_filled(s, t) for s, t in zip(sessions, texts, strict=True)])

    return filled(session, raw)


def _filled(session: str, text: str | None) -> str:
    try:
        doc = json.loads(text or "")
    except ValueError:
        doc = None
    doc = doc if isinstance(doc, dict) else {}
    lists = {k: doc[k] if isinstance(doc.get(k), list) else [] for k in SIDECAR_LISTS}
    rest = {k: v for k, v in doc.items() if k not in lists and not (k == "documents" and not isinstance(v, dict))}
    return json.dumps({"version": 1, "session": session, "stats": {}} | rest | lists, ensure_ascii=False)


def write_sidecars(docs: DataFrame, path: str) -> None:
    """(session, doc) as one JSON document a session below ``path``, a folder for each."""
    docs.select("session", sidecar(F.col("session"), F.col("doc")).alias("doc")).write.mode("overwrite").partitionBy("session").text(path)
