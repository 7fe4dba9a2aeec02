"""Reachability over whole graphs as DataFrame steps: sampled betweenness and strong components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import Steps, cut, tasks

#: Tables of a step are broadcast up to this number of rows.
BROADCAST_ROWS = 1_000_000
#: Pivots whose searches share rows.
LANES = 16


def sampled_pivots(ids: DataFrame, most: int | None) -> DataFrame:
    """(session, pivot): ``most`` ids of every session by the order of their MD5, or all of them."""
    ids = ids.select("session", F.col("id").alias("pivot")).distinct()
    if most is None:
        return ids
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.md5(F.col("pivot").cast("string")), "pivot"))
    return ids.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def pivot_betweenness(ids: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(session, id, betweenness) from ``most`` pivots a session, or from all ids, which is exact.

    ``pairs`` (session, a, b) are undirected edges, in any number and direction. All pivots are searched at once: level by
    level a table of shortest paths grows outwards, then dependencies are summed back from the last
    level to the first, each level a join with the edges and an aggregation. A row (session, block, id) has a column for each of the ``LANES`` pivots of
    its block, so an edge is followed once for all of them; edges lie by the end that they lead to, so their
    sums are made where they are read. Sums are scaled by the share of pivots and normalised by (n-1)(n-2). The number
    of steps is twice the largest distance; rows are blocks times nodes.
    """
    spark, key, lanes = ids.sparkSession, ["session", "block", "id"], range(LANES)
    p, s, x = ([f"{c}{i}" for i in lanes] for c in "psx")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS / LANES * 8 else df
    with Steps(spark) as steps:
        ids = steps.write(ids.select("session", "id").distinct())
        both = steps.write(pairs.where("a <> b").select("session", "a", "b"))
        both = both.unionByName(both.select("session", F.col("b").alias("a"), F.col("a").alias("b"))).repartition(tasks(spark, 2 * both.count()), "session", "b").distinct()
        both = steps.write(both)
        pivots = steps.write(sampled_pivots(ids, most))
        lane = F.row_number().over(Window.partitionBy("session").orderBy("pivot")) - 1
        front = pivots.select("session", F.col("pivot").alias("id"), F.floor(lane / LANES).alias("block"), (lane % LANES).alias("lane"))
        front = steps.write(front.select(*key, *(F.when(F.col("lane") == i, 1.0).otherwise(0.0).alias(p[i]) for i in lanes)))
        levels = [front]
        while True:
            out = both.withColumnRenamed("a", "id").join(small(front), ["session", "id"]).groupBy("session", "block", F.col("b").alias("id")).agg(*(F.sum(c).alias(c) for c in p))
            # A neighbour of a level is in it, in the one before, or new.
            for k, known in enumerate(levels[-2:]):
                out = out.join(known.select(*key, *(F.col(c).alias(f"_{k}{c}") for c in p)), key, "left")
            fresh = [F.when(F.greatest(F.lit(0.0), *(f"_{k}{c}" for k in range(len(levels[-2:])))) > 0, 0.0).otherwise(F.col(c)).alias(c) for c in p]
            front = steps.write(out.select(*key, *fresh).where(F.greatest(*p) > 0))
            if front.isEmpty():
                break
            levels.append(front)
        done = None
        below = steps.write(levels[-1].select("*", *(F.lit(0.0).alias(c) for c in s)))
        for i in range(len(levels) - 1, 0, -1):
            part = below.select("session", "id", sum((F.col(c) for c in s[1:]), F.col(s[0])).alias("share"))
            done = part if done is None else done.unionByName(part)
            each = below.select(*key, *(F.when(F.col(p[k]) > 0, (1 + F.col(s[k])) / F.col(p[k])).otherwise(0.0).alias(x[k]) for k in lanes))
            flow = both.withColumnRenamed("a", "id").join(small(each), ["session", "id"]).groupBy("session", "block", F.col("b").alias("id")).agg(*(F.sum(c).alias(c) for c in x))
            above = levels[i - 1].join(flow, key, "left")
            below = steps.write(above.select(*key, *p, *((F.col(p[k]) * F.coalesce(x[k], F.lit(0.0))).alias(s[k]) for k in lanes)))
        size = ids.groupBy("session").agg(F.count("*").alias("n")).join(pivots.groupBy("session").agg(F.count("*").alias("p")), "session")
        total = ids.withColumn("share", F.lit(0.0)).unionByName(done) if done is not None else ids.withColumn("share", F.lit(0.0))
        total = total.groupBy("session", "id").agg(F.sum("share").alias("share")).join(F.broadcast(size) if size.count() <= BROADCAST_ROWS else size, "session")
        norm = F.when(F.col("n") > 2, F.col("share") * F.col("n") / F.col("p") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
        return cut(total.select("session", "id", norm.alias("betweenness")))


def strong_components(steps_of: DataFrame) -> DataFrame:
    """(session, id, component): the strong component, named by its greatest id, of ids on a directed cycle of the edges (session, a, b).

    Ids that are on no cycle are not there. Edges whose ends lack a way in or out are trimmed as long as that takes a tenth of
    them. What remains gets colours: every node that of the ids that reach it which is first in a random order (by hash, another in every round). A
    node with its own colour is a root; the nodes of its colour that reach it are its component. These go, as do edges between colours, and what is left is coloured anew. Every step is a
    join on (session, node); there is no group of a session, and no bound on the length of a cycle.
    """
    with Steps(steps_of.sparkSession) as steps:
        e = steps.write(steps_of.select("session", "a", "b").where("a is not null and b is not null").distinct())
        loops = e.where("a = b").select("session", F.col("a").alias("id")).distinct()
        found, e, turn = [], steps.write(e.where("a <> b")), 0
        while True:
            # Trim: a node on a cycle has an edge in and an edge out.
            n = e.count()
            while n:
                ins, outs = e.select("session", F.col("b").alias("a")).distinct(), e.select("session", F.col("a").alias("b")).distinct()
                e = steps.write(e.join(ins, ["session", "a"], "left_semi").join(outs, ["session", "b"], "left_semi"))
                left = e.count()
                if left > 0.9 * n:
                    n = left
                    break
                n = left
            if not n:
                break
            # Colours forwards, by the greatest so far and by the colour of its id.
            turn += 1
            own = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("root"))
            colour = steps.write(e.select("session", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("colour", own))
            while True:
                above = e.join(colour.withColumnRenamed("id", "a"), ["session", "a"]).groupBy("session", F.col("b").alias("id")).agg(F.max("colour").alias("c"))
                step = colour.join(above, ["session", "id"]).select("session", "id", F.col("colour").alias("was"), F.greatest("colour", "c").alias("c"))
                jump = colour.select("session", F.col("id").alias("r"), F.col("colour").alias("cc"))
                new = steps.write(step.withColumn("r", F.col("c.root")).join(jump, ["session", "r"], "left").select("session", "id", "was", F.greatest("c", "cc").alias("colour")))
                colour = new.select("session", "id", "colour")
                if new.where("was <> colour").isEmpty():
                    break
            # Edges inside a colour, and backwards from the roots.
            e = e.join(colour.withColumnsRenamed({"id": "a", "colour": "ca"}), ["session", "a"]).join(colour.withColumnsRenamed({"id": "b", "colour": "cb"}), ["session", "b"])
            e = steps.write(e.where("ca = cb").select("session", "a", "b", F.col("ca.root").alias("colour")))
            front = steps.write(colour.where("id = colour.root").select("session", "id", F.col("id").alias("colour")))
            reached = front
            while True:
                back = front.join(e.withColumnRenamed("b", "id"), ["session", "id", "colour"]).select("session", F.col("a").alias("id"), "colour").distinct()
                front = steps.write(back.join(reached, ["session", "id", "colour"], "left_anti"))
                if front.isEmpty():
                    break
                reached = steps.write(reached.unionByName(front))
            found.append(reached.select("session", "id", F.col("colour").alias("component")))
            gone = reached.select("session", "id")
            e = steps.write(e.drop("colour").join(gone.withColumnRenamed("id", "a"), ["session", "a"], "left_anti").join(gone.withColumnRenamed("id", "b"), ["session", "b"], "left_anti"))
        out = loops.withColumn("component", F.col("id"))
        for f in found:
            # A root that only has a way to its own colour's end is alone; nodes of one alone are on no cycle.
            size = f.groupBy("session", "component").agg(F.count("*").alias("k")).where("k > 1")
            out = out.unionByName(f.join(size.drop("k"), ["session", "component"], "left_semi").select("session", "id", "component"))
        # A node of a component may have a loop, too: the component counts.
        size = out.groupBy("session", "component").agg(F.count("*").alias("k"), F.max("id").alias("name"))
        out = out.join(size, ["session", "component"])
        return cut(out.groupBy("session", "id").agg(F.max_by("name", "k").alias("component")))
