"""Graph operators over nodes (session, id, ...) and edges (session, id, from, to, ...) of all sessions at once.

Work inside a session (up to some thousand nodes) runs as one group per session; work on the corpus graph is a loop of
DataFrame steps whose lineage is cut in the shared checkpoint folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relations import falsy_default
from ..sources.files import Steps, cut, tasks
from .reach import strong_components

#: Fronts of a search are broadcast up to this number of rows.
BROADCAST_ROWS = 1_000_000
#: Nodes are broadcast to edges up to this number.
BROADCAST_NODES = 100_000
#: Children of a parent that meet all of its children in one task.
CHILDREN = 1_000


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without loops whose ends both exist. Both are counted first, so they should be cut where they cost much."""
    return _valid(nodes, edges)[0]


def _valid(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int | None]:
    """The valid edges and in how many partitions they are; None if Spark may join those, as few nodes were sent to the edges."""
    ids, out, spark = nodes.select("session", "id"), edges.where("`from` <> `to`"), edges.sparkSession
    n = ids.count()
    parts = tasks(spark, max(n, edges.count())) if n > BROADCAST_NODES else None
    ids = ids.repartition(parts, "session", "id").distinct() if parts else F.broadcast(ids.distinct())
    for end in ("from", "to"):
        out = out.repartition(parts, "session", end) if parts else out
        out = out.join(ids.withColumnRenamed("id", end), ["session", end], "left_semi")
    return out, parts


def undirected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, a, b, weight, n): the simple weighted projection; a missing or zero confidence weighs 1."""
    e = valid_edges(nodes, edges)
    w = falsy_default(F.col("confidence"), 1.0)
    return e.groupBy("session", F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.sum(w).alias("weight"), F.count("*").alias("n"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, id, degree, incident): distinct neighbours, and rows of the multigraph, which differ; one aggregation of the ends."""
    e, parts = _valid(nodes, edges)
    ends = e.select("session", F.explode(F.array(F.struct(F.col("from").alias("id"), F.col("to").alias("other")), F.struct(F.col("to").alias("id"), F.col("from").alias("other")))).alias("x")).select("session", "x.*")
    ends = ends.repartition(2 * parts, "session", "id", "other") if parts else ends  # pairs of ends hardly repeat, so they are moved before they are counted
    per = ends.groupBy("session", "id", "other").agg(F.count("*").alias("n")).groupBy("session", "id").agg(F.count("*").alias("degree"), F.sum("n").alias("incident"))
    out = nodes.select("session", "id").distinct().join(per, ["session", "id"], "left")
    return out.select("session", "id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("incident", F.lit(0)).alias("incident"))


def brandes(ids: list[str], pairs: list[tuple[str, str]]) -> dict[str, float]:
    """Exact normalised betweenness of an unweighted undirected simple graph."""
    near: dict[str, list[str]] = {i: [] for i in ids}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    total = dict.fromkeys(ids, 0.0)
    for s in ids:
        order, before, paths, far = [], {i: [] for i in ids}, {s: 1.0}, {s: 0}
        queue = [s]
        for v in queue:
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(ids)
    return {i: t / ((n - 1) * (n - 2)) if n > 2 else 0.0 for i, t in total.items()}


def _session_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (b null) and edges of every session in one frame."""
    n = nodes.select("session", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight")).distinct()
    return n.unionByName(undirected(nodes, edges).select("session", "a", "b", "weight"))


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, id, betweenness), exact, one session at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.loc[pdf.b.isna(), "a"])
        e = pdf[pdf.b.notna()].sort_values(["a", "b"])
        got = brandes(ids, list(zip(e.a, e.b, strict=True)))
        return pd.DataFrame({"session": pdf.session.iloc[0], "id": ids, "betweenness": [got[i] for i in ids]})

    return _session_graph(nodes, edges).groupBy("session").applyInPandas(run, "session string, id string, betweenness double")


def connected_components(pairs: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over (a, b); least labels of neighbours and pointer jumping, on tables of true sizes."""
    with Steps(pairs.sparkSession) as steps:
        both = steps.write(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        label = steps.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
        while True:
            # The least label around a node goes to the node and to the label that it had; then labels jump to their own label.
            near = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
            step = steps.write(label.join(near, "id").select("id", "component", F.least("component", "c").alias("c")))
            hook = step.groupBy(F.col("component").alias("id")).agg(F.min("c").alias("h"))
            up = steps.write(step.join(hook, "id", "left").select("id", F.col("component").alias("was"), F.least("c", F.coalesce("h", "c")).alias("c")))
            new = steps.write(up.join(up.select(F.col("id").alias("c"), F.col("c").alias("cc")), "c", "left").select("id", "was", F.least("c", F.coalesce("cc", "c")).alias("component")))
            label = new.select("id", "component")
            if new.where("was <> component").isEmpty():
                return cut(label)


def spread(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """(keys, id, hop): nodes within ``hops`` of the seeds (keys, id), for all keys at once; ``session`` is one of the keys.

    Edges meet the front only: it is sent to them while it is small, so no more than the edges around it are moved.
    """
    keys = list(keys)
    with Steps(edges.sparkSession) as steps:
        ids = nodes.select("session", "id").distinct()
        ends = edges.where("`from` <> `to`").select("session", F.explode(F.array(F.struct(F.col("from").alias("id"), F.col("to").alias("other")), F.struct(F.col("to").alias("id"), F.col("from").alias("other")))).alias("x")).select("session", "x.*")
        small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
        front = steps.write(seeds.select(*keys, "id").distinct().join(ids, ["session", "id"], "left_semi").withColumn("hop", F.lit(0)))
        seen = front
        for h in range(1, hops + 1):
            met = ends.join(small(front.select("session", "id").distinct()), ["session", "id"], "left_semi").distinct()  # edges that repeat are followed once
            near = met.join(small(front.drop("hop")), ["session", "id"]).select(*keys, F.col("other").alias("id")).distinct()
            near = near.join(seen, [*keys, "id"], "left_anti").join(ids, ["session", "id"], "left_semi")
            front = steps.write(near.select(*keys, "id").withColumn("hop", F.lit(h)))
            seen = seen.unionByName(front.select(seen.columns))
        return cut(seen)


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, max_nodes: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes (session, id, hop, truncated) within ``hops`` of the seeds, seeds first and by id in a hop, and their edges.

    ``truncated`` is true only if the limit was hit and nodes remain.
    """
    seen = spread(nodes, edges, seeds, hops)
    rank = F.row_number().over(_window("session", "hop", "id"))
    total = F.count("*").over(_window("session"))
    picked = seen.select("session", "id", "hop").withColumns({"_r": rank, "truncated": total > max_nodes}).where(F.col("_r") <= max_nodes).drop("_r")
    inner = edges
    for end in ("from", "to"):
        inner = inner.join(picked.select("session", F.col("id").alias(end)), ["session", end], "left_semi")
    return picked, inner


def _window(part: str, *order: str):
    from pyspark.sql import Window

    w = Window.partitionBy(part)
    return w.orderBy(*order) if order else w


def cycle_members(relations: DataFrame) -> DataFrame:
    """(session, id) of concepts on a cycle of ``is_a`` (child, parent), however long, of sessions of any size."""
    return strong_components(relations.select("session", F.col("child").alias("a"), F.col("parent").alias("b"))).select("session", "id")


def siblings(relations: DataFrame) -> DataFrame:
    """(session, a, b): concepts that share an ``is_a`` parent, a < b.

    A pair is reported by the least parent that both have, so pairs are not moved to be told apart. The children of a parent are dealt to parts of
    some ``CHILDREN``, and all of them meet each part, so no task has all pairs of one parent.
    """
    r = relations.select("session", "child", "parent").where("parent is not null").distinct()
    r = r.join(r.groupBy("session", "child").agg(F.array_sort(F.collect_list("parent")).alias("of")), ["session", "child"])
    r = r.join(r.groupBy("session", "parent").agg(F.ceil(F.count("*") / CHILDREN).alias("shards")), ["session", "parent"])
    a = r.select("session", "parent", F.col("child").alias("a"), F.col("of").alias("of_a"), F.pmod(F.xxhash64("child"), "shards").alias("shard"))
    b = r.select("session", "parent", F.col("child").alias("b"), F.col("of").alias("of_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    least = (F.size("of_a") == 1) | (F.size("of_b") == 1) | (F.array_intersect("of_a", "of_b")[0] == F.col("parent"))
    return a.join(b, ["session", "parent", "shard"]).where((F.col("a") < F.col("b")) & least).select("session", "a", "b")


def ontology_scores(edges: DataFrame, ontology: DataFrame) -> DataFrame:
    """Edges (session, id, src, dst, relation) with ``ontology_score``: 0 on a cycle or with two kinds for a pair, 0.5 for a cause between siblings, else 1."""
    isa = ontology.where("relation = 'is_a'").select("session", F.col("src").alias("child"), F.col("dst").alias("parent"))
    on_cycle = cycle_members(isa).withColumn("cyc", F.lit(True))
    both = ontology.groupBy("session", "src", "dst").agg(F.count_distinct("relation").alias("kinds")).where("kinds > 1").select("session", "src", "dst", F.lit(True).alias("both"))
    # Of all siblings, only those that an edge says to cause each other are asked for.
    asked = edges.where("relation = 'causes' and src <> dst").select("session", "src", "dst").distinct()
    sib = asked.join(isa.withColumnRenamed("child", "src"), ["session", "src"]).join(isa.withColumnRenamed("child", "dst"), ["session", "dst", "parent"], "left_semi").select("session", "src", "dst").distinct().withColumn("sib", F.lit(True))
    out = edges.join(on_cycle.select("session", F.col("id").alias("src"), F.col("cyc").alias("c1")), ["session", "src"], "left")
    out = out.join(on_cycle.select("session", F.col("id").alias("dst"), F.col("cyc").alias("c2")), ["session", "dst"], "left")
    out = out.join(both, ["session", "src", "dst"], "left").join(sib, ["session", "src", "dst"], "left")
    bad = (F.col("relation") == "is_a") & F.col("c1").isNotNull() & F.col("c2").isNotNull()
    score = F.when(bad | F.col("both").isNotNull(), 0.0).when((F.col("relation") == "causes") & F.col("sib").isNotNull(), 0.5).otherwise(1.0)
    return out.withColumn("ontology_score", score).drop("c1", "c2", "both", "sib")


def representative(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, community_id, id): per community the node with most incident rows, then the first id."""
    d = nodes.select("session", "id", "community_id").join(degree(nodes, edges), ["session", "id"])
    return d.groupBy("session", "community_id").agg(F.min_by("id", F.struct(-F.col("incident"), "id")).alias("id"))


def community_relations(edges: DataFrame, members: DataFrame, limit: int = 30) -> DataFrame:
    """The first ``limit`` relations (from, to, glyph order) inside each community of (community, id)."""
    a, b = (members.select("community", F.col("id").alias(e)) for e in ("from", "to"))
    inner = edges.join(a, "from").join(b, ["community", "to"])
    return inner.withColumn("rank", F.row_number().over(_window("community", "from", "to", "glyph"))).where(F.col("rank") <= limit)


def acyclic_skeleton(edges: DataFrame) -> DataFrame:
    """Edges of a greedy acyclic subgraph per session: by falling confidence, then id, one that closes a cycle is left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        down: dict[str, set[str]] = {}
        keep = []
        for r in pdf.sort_values(["confidence", "id"], ascending=[False, True], na_position="last").itertuples(index=False):
            src, dst = getattr(r, "src"), getattr(r, "dst")
            todo, seen = [dst], {dst}
            while todo and src not in seen:
                for x in down.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            if src not in seen:
                down.setdefault(src, set()).add(dst)
                keep.append(r)
        return pd.DataFrame(keep, columns=pdf.columns)

    src = edges.select("session", "id", F.col("from").alias("src"), F.col("to").alias("dst"), "confidence")
    return src.groupBy("session").applyInPandas(run, src.schema).withColumnsRenamed({"src": "from", "dst": "to"})


def longest_path_layers(dag: DataFrame) -> DataFrame:
    """(session, id, layer) of a DAG: 0 for roots, else 1 + the largest layer of a predecessor; a cycle is an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        down: dict[str, list[str]] = {}
        above: dict[str, int] = {}
        for a, b in zip(pdf.src.tolist(), pdf.dst.tolist(), strict=True):
            down.setdefault(a, []).append(b)
            above[b] = above.get(b, 0) + 1
            above.setdefault(a, 0)
        layer = {x: 0 for x in above if not above[x]}
        todo = list(layer)
        for v in todo:
            for w in down.get(v, ()):
                layer[w] = max(layer.get(w, 0), layer[v] + 1)
                above[w] -= 1
                if not above[w]:
                    todo.append(w)
        if len(todo) < len(above):
            raise ValueError(f"session {pdf.session.iloc[0]} has a cycle")
        return pd.DataFrame({"session": [pdf.session.iloc[0]] * len(todo), "id": todo, "layer": [layer[x] for x in todo]}, dtype=object)

    steps = dag.select("session", F.col("from").alias("src"), F.col("to").alias("dst")).where("src is not null and dst is not null").distinct()
    kind = {f.name: f.dataType.simpleString() for f in steps.schema}
    return steps.groupBy("session").applyInPandas(run, f"session {kind['session']}, id {kind['src']}, layer int")


def tree_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, id): nodes without an incoming edge, else the first id of a session that has none."""
    e = valid_edges(nodes, edges)
    ids = nodes.select("session", "id").distinct()
    roots = ids.join(e.select("session", F.col("to").alias("id")).distinct(), ["session", "id"], "left_anti")
    none = ids.join(roots.select("session").distinct(), "session", "left_anti").groupBy("session").agg(F.min("id").alias("id"))
    return roots.unionByName(none)


