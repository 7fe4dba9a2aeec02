"""The corpus graph of all sessions, keyword search over it, retrieval for questions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.containment import containing
from ..functions.text import evidence_text, member_fingerprint, normalize_label
from ..sources.files import cut
from . import community, graph


def merge_nodes(nodes: DataFrame, norm=normalize_label) -> DataFrame:
    """(label_norm, label, onto_class, importance, sources): label of the newest session's first node, all sources, most importance.

    ``nodes`` may carry ``importance``; the class is the first one that is not empty, newest session first.
    """
    imp = F.coalesce("importance", F.lit(0.0)) if "importance" in nodes.columns else F.lit(0.0)
    n = nodes.withColumns({"label_norm": norm(F.col("label")), "_i": imp, "_o": F.coalesce("onto_class", F.lit(""))}).where("label_norm <> ''")
    n = n.withColumn("_age", F.dense_rank().over(Window.partitionBy("label_norm").orderBy(F.desc("session"))))
    source = F.struct("_age", "id", "session", "label", F.col("community_id"), F.col("_o").alias("onto_class"), F.col("_i").alias("importance"))
    sources = F.transform(F.array_sort(F.collect_list(source)), lambda s: F.struct(s["session"].alias("session"), s["id"].alias("node_id"), s["label"].alias("label"), s["community_id"].alias("community_id"), s["onto_class"].alias("onto_class"), s["importance"].alias("importance")))
    return n.groupBy("label_norm").agg(
        F.min_by("label", F.struct("_age", "id")).alias("label"),
        F.coalesce(F.min_by("_o", F.when(F.col("_o") != "", F.struct("_age", "id"))), F.lit("")).alias("onto_class"),
        F.max("_i").alias("importance"),
        sources.alias("sources"),
    )


def labelled_edges(nodes: DataFrame, edges: DataFrame, norm=normalize_label) -> DataFrame:
    """Edges with the labels of both ends and their normal forms; those without an existing end are dropped."""
    e = edges
    for end in ("from", "to"):
        e = e.join(nodes.select("session", F.col("id").alias(end), F.col("label").alias(f"{end}_label"), norm(F.col("label")).alias(f"{end}_norm")), ["session", end])
    return e


def merge_edges(labelled: DataFrame) -> DataFrame:
    """(from_norm, to_norm, glyph, label, weight, sources): weight counts occurrences, the label is the newest session's first."""
    e = labelled.withColumn("glyph", F.coalesce(F.when(F.col("glyph") != "", F.col("glyph")), F.lit("wave")))
    ev = evidence_text(F.col("evidence_span")) if "evidence_span" in labelled.columns else F.lit("")
    src = F.struct("session", F.col("id").alias("edge_id"), F.coalesce("label", F.lit("")).alias("label"), ev.alias("evidence"))
    top = e.withColumn("_age", F.dense_rank().over(Window.partitionBy("from_norm", "to_norm", "glyph").orderBy(F.desc("session"))))
    return top.groupBy("from_norm", "to_norm", "glyph").agg(F.min_by("label", F.struct("_age", "id")).alias("label"), F.count("*").alias("weight"), F.sort_array(F.collect_list(src), asc=False).alias("sources"))


def undirected_weights(corpus_edges: DataFrame) -> DataFrame:
    """(a, b, weight): summed over direction and glyph, without loops."""
    return corpus_edges.where("from_norm <> to_norm").groupBy(F.least("from_norm", "to_norm").alias("a"), F.greatest("from_norm", "to_norm").alias("b")).agg(F.sum("weight").cast("double").alias("weight"))


def community_steps(pairs: DataFrame) -> DataFrame:
    """(level, step, id, community, modularity): the steps of both resolutions, see :func:`community.corpus_levels`."""
    parts = [community.corpus_levels(pairs, gamma).select(F.lit(level).alias("level"), "*") for level, gamma in S.CORPUS_RESOLUTIONS.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def two_level_communities(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(level, community, label_norm, modularity): coarse and fine communities of the corpus graph; nodes without an edge are alone.

    ``modularity`` is that of the level.
    """
    steps = cut(community_steps(pairs))
    last = steps.groupBy("level").agg(F.max("step").alias("step"), F.max_by("modularity", "step").alias("modularity"))
    found = steps.drop("modularity").join(F.broadcast(last), ["level", "step"], "left_semi").select("level", F.col("id").alias("label_norm"), "community")
    levels = pairs.sparkSession.createDataFrame([(x,) for x in S.CORPUS_RESOLUTIONS], "level string").join(F.broadcast(last.drop("step")), "level", "left")
    out = F.broadcast(levels).crossJoin(ids.select("label_norm").distinct()).join(found, ["level", "label_norm"], "left")  # two levels
    return out.select("level", F.concat("level", F.lit(":"), F.coalesce("community", "label_norm")).alias("community"), "label_norm", F.coalesce("modularity", F.lit(0.0)).alias("modularity"))


def summaries_to_make(communities: DataFrame, cached: DataFrame) -> DataFrame:
    """(level, community, members, fingerprint, summary): the cached summary of the same set of members, if there is one."""
    m = communities.groupBy("level", "community").agg(F.array_sort(F.collect_list("label_norm")).alias("members"))
    return m.withColumn("fingerprint", member_fingerprint(F.col("members"))).join(cached.select("fingerprint", "summary"), "fingerprint", "left")


def search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Index rows that contain ``query`` (wildcards are plain characters): exact labels, then newest session, then importance.

    Free places are filled with edges whose label or evidence has it. ``rank`` from 1; ``kind`` is node or edge.
    """
    import unicodedata

    q = unicodedata.normalize("NFKC", query).strip().casefold()
    cols = ["rank", "kind", "session", "id", "label", "exact"]
    n = nodes.where(F.col("label_norm").contains(q) & F.lit(bool(q))).withColumn("exact", F.col("label_norm") == q)
    n = n.orderBy(F.desc("exact"), F.desc("session"), F.desc("importance"), "label_norm", "node_id").limit(limit)
    order = Window.orderBy(F.desc("exact"), F.desc("session"), F.desc("importance"), "label_norm", "node_id")
    n = n.select(F.row_number().over(order).alias("rank"), F.lit("node").alias("kind"), "session", F.col("node_id").alias("id"), "label", "exact")
    text = F.lower(F.concat_ws("\n", "label", "evidence"))
    e = edges.where(text.contains(q) & F.lit(bool(q))).orderBy(F.desc("session"), "from_norm", "to_norm", "edge_id").limit(limit)
    e = e.select(F.row_number().over(Window.orderBy(F.desc("session"), "from_norm", "to_norm", "edge_id")).alias("r"), "session", F.col("edge_id").alias("id"), "label")
    e = e.join(n.agg(F.count("*").alias("k"))).select((F.col("r") + F.col("k")).alias("rank"), F.lit("edge").alias("kind"), "session", "id", "label", F.lit(False).alias("exact"))
    return n.select(cols).unionByName(e.select(cols)).where(F.col("rank") <= limit).orderBy("rank")


def known_terms(questions: DataFrame, vocabulary: DataFrame, most: int = 6) -> DataFrame:
    """(question, term): vocabulary terms in the question, without those inside a longer hit, longest first, ``most`` of them."""
    asked = questions.select("question", F.lower("question").alias("text")).distinct()
    hits = containing(asked, vocabulary).join(asked, "text").select("question", "term").distinct()
    longer = hits.withColumnRenamed("term", "long")
    inside = hits.join(longer, "question").where("term <> long and contains(long, term)").select("question", "term").distinct()
    left = hits.join(inside, ["question", "term"], "left_anti")
    return left.withColumn("_r", F.row_number().over(Window.partitionBy("question").orderBy(F.desc(F.length("term")), "term"))).where(F.col("_r") <= most).drop("_r")


def seeds(hits: DataFrame, most: int = 8) -> DataFrame:
    """Node hits (question, term_pos, rank, session, id) in order of terms, once each, ``most`` per question, with their ``place``."""
    one = hits.where("kind = 'node'").groupBy("question", "session", "id").agg(F.min(F.struct("term_pos", "rank")).alias("o"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("o", "session", "id"))).where(F.col("place") <= most).drop("o")


def communities_of_questions(members: DataFrame, questions: DataFrame, terms: DataFrame, top: int = 3) -> DataFrame:
    """(question, rank, community, score, size): the ``top`` communities (community, member) for every question.

    The score counts pairs of a member and a term (question, term) of which one contains the other; then the larger community counts, then the
    least id. Communities without a hit come last, so a question without terms gets the largest ones. Overlaps are found once for all
    distinct terms and members, not for each question.
    """
    m = members.select("community", "member").where("member is not null").distinct()
    size = cut(m.groupBy("community").agg(F.count("*").alias("size")))
    names, words = m.select("member").distinct(), terms.select("term").distinct()
    both = containing(names, words, text="member").unionByName(containing(words, names, text="term", term="member").select("member", "term")).distinct()
    asked = terms.select("question", "term").distinct()
    score = asked.join(both, "term").join(m, "member").groupBy("question", "community").agg(F.count("*").alias("score"))
    # Of those without a hit, only the largest can be among the first: at most as many as are asked for stand before them.
    most = size.orderBy(F.desc("size"), "community").limit(2 * top).collect()  # 2 * top rows
    if not most:
        return questions.select("question", F.lit(0).alias("rank"), F.lit(None).cast(m.schema["community"].dataType).alias("community"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("size")).where("false")
    large = F.explode(F.array(*(F.lit(r.community) for r in most))).alias("community")
    rows = score.unionByName(questions.select("question").distinct().select("question", large, F.lit(0).cast("long").alias("score")))
    rows = rows.groupBy("question", "community").agg(F.max("score").alias("score")).join(size, "community")
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), F.desc("size"), "community"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("question", "rank", "community", "score", "size")


def rank_communities(members: DataFrame, terms: DataFrame, top: int = 3) -> DataFrame:
    """The communities for the terms (term) of one question, see :func:`communities_of_questions`."""
    one = terms.select(F.lit("").alias("question"), "term")
    asked = members.sparkSession.createDataFrame([("",)], "question string")
    return communities_of_questions(members, asked, one, top).select("community", "score", "size", "rank")


def global_materials(members: DataFrame, questions: DataFrame, terms: DataFrame, cached: DataFrame, labels: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(question, rank, community, title, summary, cached): summaries of the best communities for every question.

    A summary belongs to a set of members, by its fingerprint: it is found again for the same set under another id, and no more once a member
    changes. ``summary`` is null where one is to be made. The title has the labels of the first two members and how many more there are. ``cached``:
    (fingerprint, summary); ``labels``: (member, label).
    """
    ranked = cut(communities_of_questions(members, questions, terms, top))
    used = ranked.select("community").distinct()
    m = members.select("community", "member").where("member is not null").distinct().join(used, "community")
    named = m.join(labels.select("member", "label"), "member", "left") if labels is not None else m.withColumn("label", F.col("member"))
    per = named.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("member", F.coalesce("label", "member").alias("label")))).alias("l"))
    rest = F.size("l") - 2
    title = F.concat(F.array_join(F.slice("l.label", 1, 2), "・"), F.when(rest > 0, F.format_string(" ほか %d 概念", rest)).otherwise(""))
    per = per.select("community", title.alias("title"), member_fingerprint(F.col("l.member")).alias("fingerprint"))
    one = cached.where("coalesce(summary, '') <> ''").groupBy("fingerprint").agg(F.min("summary").alias("summary"))
    told = per.join(one, "fingerprint", "left")
    return ranked.join(told, "community").select("question", "rank", "community", "title", "summary", F.col("summary").isNotNull().alias("cached"))


def node_documents(edges: DataFrame) -> DataFrame:
    """(session, id, document_id) of nodes whose edges' spans name one document only."""
    d = edges.select("session", F.explode(F.array("from", "to")).alias("id"), F.explode("evidence_span.document_id").alias("document_id")).where("document_id <> ''")
    return d.groupBy("session", "id").agg(F.count_distinct("document_id").alias("k"), F.min("document_id").alias("document_id")).where("k = 1").drop("k")


def local_materials(nodes: DataFrame, edges: DataFrame, seed_nodes: DataFrame, hops: int = 2, max_nodes: int = 40) -> tuple[DataFrame, DataFrame]:
    """Concepts and relations for many questions at once, from seeds (question, place, session, id).

    Concepts: (question, place, session, id, hop, seed, truncated). The sessions of a question come in the order of their first seeds. The
    first has the budget of ``max_nodes``, what it leaves goes to the next, and so on; in a session seeds come first, then by hop and id. As every
    session takes all that is left, that is the first ``max_nodes`` of one order, and one search keyed by (question, session) is enough.
    ``truncated`` says that nodes of the question were left out. Relations: edges between concepts, (question, session, id, from, to) and what else edges have.
    """
    found = graph.spread(nodes, edges, seed_nodes, hops, ("question", "session"))
    first = seed_nodes.groupBy("question", "session").agg(F.min("place").alias("turn"))
    w = Window.partitionBy("question").orderBy("turn", "session", "hop", "id")
    picked = found.join(first, ["question", "session"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_nodes + 1)
    over = picked.where(F.col("place") > max_nodes).select("question", F.lit(True).alias("truncated"))
    concepts = picked.where(F.col("place") <= max_nodes).join(over, "question", "left")
    concepts = cut(concepts.select("question", "place", "session", "id", "hop", (F.col("hop") == 0).alias("seed"), F.coalesce("truncated", F.lit(False)).alias("truncated")))
    ends = [concepts.select("question", "session", F.col("id").alias(end)) for end in ("from", "to")]
    more = [c for c in edges.columns if c not in ("question", "session", "id", "from", "to")]
    relations = edges.where("`from` <> `to`").select("session", "id", "from", "to", *more).join(ends[0], ["session", "from"]).join(ends[1], ["question", "session", "to"], "left_semi")
    return concepts, relations.select("question", "session", "id", "from", "to", *more)


def local_material(nodes: DataFrame, edges: DataFrame, seed_nodes: DataFrame, hops: int = 2, max_nodes: int = 40) -> tuple[DataFrame, DataFrame]:
    """Concepts and relations of one question, see :func:`local_materials`; seeds (session, id) without a place count by session and id."""
    place = F.col("place") if "place" in seed_nodes.columns else F.row_number().over(Window.orderBy("session", "id"))  # of one question: eight seeds
    one = seed_nodes.select(F.lit("").alias("question"), "session", "id", place.alias("place"))
    concepts, relations = local_materials(nodes, edges, one, hops, max_nodes)
    return concepts.drop("question"), relations.drop("question")


def merge_material(*parts: DataFrame) -> DataFrame:
    """Union of (ref, kind, text) in the order given; the first of equal refs wins."""
    out = None
    for i, p in enumerate(parts):
        p = p.select("ref", "kind", "text", F.lit(i).alias("_p"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("ref").agg(F.min_by(F.struct("kind", "text"), "_p").alias("m")).select("ref", "m.*")


def offline_answer(relations: DataFrame) -> DataFrame:
    """(question, answer): the relations listed in order, without a language model."""
    line: Column = F.concat(F.lit("- "), F.col("from_label"), F.lit(" → "), F.col("to_label"), F.lit(" ("), F.col("glyph"), F.lit(")"))
    return relations.groupBy("question").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("answer"))
