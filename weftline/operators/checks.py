"""Checks of graphs and drawings: violations, reconciliation of two scenes, overlapping rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import cut, tasks

#: Ids of the same rectangle in a block.
BLOCK = 1_000
#: Pairs of ids that are tried in a task.
PAIRS = 20_000_000
#: Sizes of cells are broadcast up to this number.
BROADCAST_ROWS = 1_000_000


def violations(nodes: DataFrame, edges: DataFrame, islands: DataFrame | None = None) -> DataFrame:
    """(session, kind, id): duplicate ids, dangling ends, self loops, nodes of islands that do not exist."""
    dup = lambda df, kind: df.groupBy("session", "id").agg(F.count("*").alias("k")).where("k > 1").select("session", F.lit(kind).alias("kind"), "id")
    out = dup(nodes, "duplicate_node").unionByName(dup(edges, "duplicate_edge"))
    ids = nodes.select("session", "id").distinct()
    for end in ("from", "to"):
        out = out.unionByName(edges.join(ids.withColumnRenamed("id", end), ["session", end], "left_anti").select("session", F.lit(f"dangling_{end}").alias("kind"), "id"))
    out = out.unionByName(edges.where("`from` = `to`").select("session", F.lit("self_loop").alias("kind"), "id"))
    if islands is not None:
        lost = nodes.join(islands.select("session", F.col("id").alias("community_id")), ["session", "community_id"], "left_anti")
        out = out.unionByName(lost.select("session", F.lit("missing_island").alias("kind"), "id"))
    return out


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(id, status): ids of the plan that the scene lacks, or whose label differs; a label cut by a broken character counts as its prefix."""
    both = expected.select("id", F.col("label").alias("want")).join(actual.select("id", F.col("label").alias("have"), F.lit(True).alias("seen")), "id", "left")
    cut = F.substring_index("have", "�", 1)
    same = (F.col("want") == F.col("have")) | (F.col("have").contains("�") & F.col("want").startswith(cut))
    status = F.when(F.col("seen").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "ok").otherwise("label_differs")
    return both.select("id", status.alias("status"))


def overlaps(boxes: DataFrame, cell: int = 128) -> DataFrame:
    """(session, a, b): pairs of rectangles (x, y, w, h) that intersect, by an equi-join on grid cells and the exact test.

    Rectangles that are the same meet once, in blocks of ids, and each pair of blocks is reported in one cell only, that of the upper left corner of
    its intersection. A crowded cell is split into a grid of slots, so that some ``PAIRS`` pairs of ids at most meet in each. Pairs
    are made where blocks meet: neither they nor pairs of blocks are moved, so disk grows with the rectangles, only the result with the pairs.
    """
    spark, box, at = boxes.sparkSession, ["session", "x", "y", "w", "h"], lambda v: F.floor(v / cell)
    rows = boxes.select(*box, "id").where(" and ".join(f"{k} is not null" for k in (*box, "id")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.count("*").over(Window.partitionBy(*box)) / BLOCK)))
    blocks = cut(rows.groupBy(*box, "part").agg(F.collect_list("id").alias("ids")).drop("part")).withColumn("no", F.monotonically_increasing_id())
    cells = blocks.withColumn("cx", F.explode(F.sequence(at(F.col("x")), at(F.col("x") + F.col("w"))))).withColumn("cy", F.explode(F.sequence(at(F.col("y")), at(F.col("y") + F.col("h")))))
    sizes = cut(cells.groupBy("session", "cx", "cy").agg(F.sum(F.size("ids")).alias("n")).withColumn("grid", F.ceil(F.col("n") / PAIRS**0.5)))
    tried = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0
    sizes = sizes.drop("n")
    parts, keys = tasks(spark, tried, PAIRS), ["session", "cx", "cy", "slot_a", "slot_b"]
    cells = cells.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, ["session", "cx", "cy"]).withColumn("slot", F.pmod(F.xxhash64("no"), "grid"))
    # A block of one side is in all slots from its own on, one of the other side in all up to its own: of two slots, one pair meets.
    side = lambda s, *slots: cells.select("session", "cx", "cy", *slots, *(F.col(k).alias(f"{k}_{s}") for k in ("no", "x", "y", "w", "h", "ids"))).repartition(parts, *keys)
    a = side("a", F.col("slot").alias("slot_a"), F.explode(F.sequence("slot", F.col("grid") - 1)).alias("slot_b"))
    b = side("b", F.explode(F.sequence(F.lit(0).cast("long"), "slot")).alias("slot_a"), F.col("slot").alias("slot_b"))
    met = a.join(b, keys).where("(slot_a < slot_b or no_a <= no_b) and x_a < x_b + w_b and x_b < x_a + w_a and y_a < y_b + h_b and y_b < y_a + h_a")
    met = met.where((F.col("cx") == at(F.greatest("x_a", "x_b"))) & (F.col("cy") == at(F.greatest("y_a", "y_b")))).withColumn("same", F.expr("no_a = no_b"))
    out = met.select("session", "same", F.explode("ids_a").alias("i"), "ids_b").select("session", "same", "i", F.explode("ids_b").alias("j"))
    return out.where("i < j or (i > j and not same)").select("session", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
