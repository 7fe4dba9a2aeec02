"""A typed graph, logs and judgements derived from the driver's tables, as SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..sources.files import cut, tasks

#: Two graphs of all line items: g joins 5 segments and 25 nations, sp some thousand parts' kinds and suppliers, so it is sparse.
#: One session a month; a relation per line item. (order, line) is not unique, so ids are numbered in a total order.
BASE = """
e AS (
    SELECT session, 'r' || lpad(CAST(row_number() OVER (PARTITION BY session ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS VARCHAR(10)), 6, '0') AS id,
           from_label, to_label, from_wide, to_wide, glyph, confidence, label, l_quantity AS quantity, l_tax AS tax, brand
    FROM (
        SELECT l.*, {month} AS session, c.c_mktsegment AS from_label, n.n_name AS to_label,
               CASE WHEN l.l_returnflag = 'R' THEN 'arrow' WHEN l.l_returnflag = 'A' THEN 'wave' WHEN l.l_linestatus = 'O' THEN 'double' ELSE 'isa' END AS glyph,
               round(1 - l.l_discount, 2) AS confidence, p.p_name AS label, p.p_brand AS brand, p.p_brand || '/' || p.p_size AS from_wide, s.s_name AS to_wide
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey
    ) x
),
labels_all AS (
    SELECT DISTINCT c_mktsegment AS label, 'comm_seg' AS community_id FROM customer
    UNION SELECT DISTINCT n_name, 'comm_' || CAST(n_nationkey % 5 AS VARCHAR(2)) FROM nation
),
months AS (SELECT DISTINCT {month} AS session FROM orders o),
n AS (SELECT s.session, l.label AS id, l.label, l.community_id FROM months s CROSS JOIN labels_all l),
g AS (SELECT session, id, from_label AS "from", to_label AS "to", label, glyph, confidence, quantity, tax, brand FROM e),
labels_wide AS (
    SELECT DISTINCT p_brand || '/' || p_size AS label, 'comm_' || CAST(p_size % 25 AS VARCHAR(2)) AS community_id FROM part
    UNION SELECT DISTINCT s_name, 'comm_' || CAST(s_nationkey AS VARCHAR(2)) FROM supplier
),
nw AS (SELECT s.session, l.label AS id, l.label, l.community_id FROM months s CROSS JOIN labels_wide l),
sp AS (SELECT session, id, from_wide AS "from", to_wide AS "to", label, glyph, confidence, quantity, tax, brand FROM e)
"""
MONTH = {"spark": "date_format(o.o_orderdate, 'yyyyMM')", "duckdb": "strftime(o.o_orderdate, '%Y%m')"}
#: Ranges of orders are broadcast up to this number.
BROADCAST_ROWS = 1_000_000
#: Orders whose rows are numbered together.
ORDERS = 1 << 20
#: What edges have besides their ends.
ATTRIBUTES = ("label", "glyph", "confidence", "quantity", "tax", "brand")
TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "part")

#: The activity log read as an edit log: the user is the session.
EDITS = """
d AS (
    SELECT CAST(user_id AS VARCHAR(20)) AS session, 'e-' || CAST(event_id AS VARCHAR(20)) AS edit_id, event_id AS seq,
           CASE event_type WHEN 'signup' THEN 'add_node' WHEN 'click' THEN 'rename_node' WHEN 'purchase' THEN 'retype_edge' WHEN 'error' THEN 'revert' ELSE CASE WHEN event_id % 2 = 0 THEN 'delete_node' ELSE 'delete_edge' END END AS op,
           CASE WHEN event_type = 'error' THEN 'e-' || CAST(event_id - 1 - event_id % 7 AS VARCHAR(20)) ELSE 'x' || CAST(event_id % 17 AS VARCHAR(5)) END AS target,
           'from' || CAST(event_id % 13 AS VARCHAR(5)) AS from_label, 'to' || CAST(event_id % 11 AS VARCHAR(5)) AS to_label,
           CASE WHEN event_id % 3 = 0 THEN 'arrow' ELSE 'wave' END AS old_glyph, CASE WHEN event_id % 4 = 0 THEN 'arrow' ELSE 'wave' END AS new_glyph,
           lpad(CAST(event_id AS VARCHAR(20)), 12, '0') AS ts
    FROM events
)
"""


def duckdb(sql: str, base: str = BASE) -> str:
    """DuckDB SQL over the derived relations."""
    return f"WITH {base.format(month=MONTH['duckdb'])} {sql}"


#: Orders have met their customers when they meet the line items, last of all: these are moved as few times as possible.
_FROM = re.compile(r"FROM lineitem l JOIN orders o (ON .*?) JOIN customer c (ON .*?)\n\s+(JOIN supplier .*)\n")
_ORDERS = "SELECT o.o_orderkey, {month} AS session, c.c_mktsegment FROM orders o JOIN customer c"


def relation(spark: SparkSession, sf_dir: str, name: str, base: str = BASE, tables: tuple[str, ...] = TABLES, placed: bool = False) -> DataFrame:
    """A derived relation as a DataFrame, its joins in the order that suits Spark; with ``placed`` orders come from the view of that name."""
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    orders = "placed" if placed else rf"({_ORDERS} \2)"
    base, n = _FROM.subn(rf"FROM lineitem l \3 JOIN {orders} o \1\n", base)
    base = base.replace("{month} AS session, c.c_mktsegment", "o.session, o.c_mktsegment", 1) if n else base
    return spark.sql(f"WITH {base.format(month=MONTH['spark'])} SELECT * FROM {name}".replace('"', "`"))


def numbered(spark: SparkSession, sf_dir: str, *only: str, once: bool = False) -> DataFrame:
    """The relation ``e`` or columns ``only`` of it, derived once (with ``once`` it is read once and not stored), its rows numbered where the join with the orders has put them.

    Orders have their place in the session (rows of the orders before); only the rows of an order are numbered among each other. So line items are not moved or sorted by session.
    """
    _placed(spark, sf_dir).createOrReplaceTempView("placed")
    base = BASE.partition(",\nlabels_all AS")[0].replace("PARTITION BY session ORDER", "PARTITION BY session, l_orderkey ORDER")
    base = re.sub(r"CAST\((row_number\(\) OVER \(.*?\)) AS VARCHAR\(10\)\)", r"CAST(\1 + before AS VARCHAR(10))", base, count=1)
    e = relation(spark, sf_dir, "e", base.replace("{month} AS session", "o.before, {month} AS session", 1), placed=True)
    e = e.select("session", "id", *only) if only else e
    return e if once else cut(e)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (o_orderkey, session, c_mktsegment) with ``before``: the rows that orders of smaller keys have in the session, within ranges of orders and then by the sizes of the ranges."""
    t = {name: table(spark, sf_dir, name) for name in TABLES}
    lines = t["lineitem"].select("l_orderkey", "l_suppkey", "l_partkey")
    s = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).groupBy("s_suppkey").agg(F.count("*").alias("_s"))
    p = t["part"].groupBy("p_partkey").agg(F.count("*").alias("_p"))
    s = F.broadcast(s) if s.count() <= BROADCAST_ROWS else s
    p = F.broadcast(p) if p.count() <= BROADCAST_ROWS else p
    n = lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sum(F.col("_s") * F.col("_p")).alias("n"))
    o = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.expr(MONTH["spark"].replace("o.", "")).alias("session"), "c_mktsegment")
    o = o.join(n, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("part", F.expr(f"o_orderkey DIV {ORDERS}"))
    within = F.sum("n").over(Window.partitionBy("session", "part").orderBy("o_orderkey").rangeBetween(Window.unboundedPreceding, -1))
    o = cut(o.select("o_orderkey", "session", "c_mktsegment", "part", "n", F.coalesce(within, F.lit(0)).alias("within")))
    earlier = F.sum("n").over(Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = cut(o.groupBy("session", "part").agg(F.sum("n").alias("n")).select("session", "part", F.coalesce(earlier, F.lit(0)).alias("earlier")))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    return o.join(parts.select(F.col("session").alias("_s"), F.col("part").alias("_p"), "earlier"), F.col("session").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).select("o_orderkey", "session", "c_mktsegment", (F.col("within") + F.col("earlier")).alias("before"))


def edges(spark: SparkSession, sf_dir: str, wide: bool = False, attributes: tuple[str, ...] = ATTRIBUTES, once: bool = False) -> DataFrame:
    """Edges with ids as ends and ``attributes``, of the dense or of the wide graph; derived once, as operators read them several times, but for ``once``."""
    a, b = ("from_wide", "to_wide") if wide else ("from_label", "to_label")
    return numbered(spark, sf_dir, a, b, *attributes, once=once).select("session", "id", F.col(a).alias("from"), F.col(b).alias("to"), *attributes)


def ends(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """The ends (session, from, to) of the edges, for operators that ask for no more: nothing is numbered."""
    return cut(relation(spark, sf_dir, "sp" if wide else "g").select("session", "from", "to"))


def nodes(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Every label in every month; the labels lie in many partitions and the few months come to them, so no task has all nodes."""
    labels, months = cut(relation(spark, sf_dir, "labels_wide" if wide else "labels_all")), cut(relation(spark, sf_dir, "months"))
    labels = labels.repartition(tasks(spark, labels.count() * months.count()), "label")
    return labels.join(F.broadcast(months)).select("session", F.col("label").alias("id"), "label", "community_id")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "d", EDITS, ("events",))
