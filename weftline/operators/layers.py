"""Layer tags, claims and their validation: joins of sentences, zones, claims, concepts and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.relations import causal_candidates, judge
from ..functions.containment import containing
from ..functions.text import LEAST_CONTAINED, claim_polarity, evidence_text, normalize_label, opposite_words
from ..sources.files import cut


def _near_texts(texts: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, zt): distinct pairs of a text and another (zt) that are equal, or of which one contains the other and both have eight characters."""
    t, z = texts.select(*keys, "text").distinct(), others.select(*keys, "zt").distinct()
    long_t, long_z = t.where(F.length("text") >= LEAST_CONTAINED), z.where(F.length("zt") >= LEAST_CONTAINED)
    inside = containing(long_z, long_t, tuple(keys), "zt", "text").select(*keys, "text", "zt").unionByName(containing(long_t, long_z, tuple(keys), "text", "zt").select(*keys, "text", "zt"))
    same = t.select(*keys, "text", F.col("text").alias("zt")).join(z, [*keys, "zt"], "left_semi")
    return inside.unionByName(same.select(*keys, "text", "zt")).distinct()


def zone_of_text(texts: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Texts (keys, text) with the label of their sentence: the same text first, else the first that contains it or is contained."""
    z = zones.select(*keys, F.col("text").alias("zt"), "zone_label", "pos")
    t = texts.select(*keys, "text").distinct()
    # One within the other: both have eight characters then.
    long_t, long_z = t.where(F.length("text") >= LEAST_CONTAINED), z.select(*keys, "zt").where(F.length("zt") >= LEAST_CONTAINED)
    pairs = containing(long_z, long_t, tuple(keys), "zt", "text").select(*keys, "text", "zt").unionByName(containing(long_t, long_z, tuple(keys), "text", "zt").select(*keys, "text", "zt"))
    same = t.select(*keys, "text", F.col("text").alias("zt"))
    found = pairs.unionByName(same).distinct().join(z, [*keys, "zt"])
    return found.groupBy(*keys, "text").agg(F.min_by("zone_label", F.struct(F.col("text") != F.col("zt"), "pos")).alias("zone_label"))


def first_tags(glyph: Column, zone: Column | None = None) -> Column:
    """Layer tags by glyph, and the discourse tag of the sentence's zone; null for glyphs that no layer expresses."""
    parts = []
    for layer in S.LAYERS:
        own = [F.when(glyph == g, t) for g, (n, t) in S.GLYPH_TAGS.items() if n == layer]
        if layer == "layer_B" and zone is not None:
            own += [F.when((zone == z) & ~glyph.isin("hole", "tension"), t) for z, t in S.ZONE_TAGS.items()]
        parts.append(F.array_compact(F.array(*own) if own else F.array(F.lit(None).cast("string"))).alias(layer))
    return F.struct(*parts)


def add_ontology_tags(edges: DataFrame, ontology: DataFrame) -> DataFrame:
    """Edges with is_a and part_of of the ontology's relations between the same labels in the same direction."""
    o = ontology.groupBy("session", "from_norm", "to_norm").agg(F.array_sort(F.collect_set("relation")).alias("_o"))
    e = edges.join(o, ["session", "from_norm", "to_norm"], "left")
    a = F.filter(F.array(*map(F.lit, S.LAYERS["layer_A"])), lambda t: F.array_contains(F.array_union(F.col("layer_tags.layer_A"), F.coalesce("_o", F.array().cast("array<string>"))), t))
    return e.withColumn("layer_tags", F.col("layer_tags").withField("layer_A", a)).drop("_o")


def claims_of_nodes(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session, id, claim_refs) of nodes whose label a claim names."""
    c = claims.select("session", "claim_id", F.explode("concepts").alias("concept")).withColumn("_n", normalize_label(F.col("concept")))
    n = nodes.select("session", "id", normalize_label(F.col("label")).alias("_n"))
    return c.join(n, ["session", "_n"]).groupBy("session", "id").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_refs"))


def claims_of_edges(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, id, claim_refs) of edges whose evidence is a claim's sentence, or contains it or is contained."""
    e = edges.select("session", "id", evidence_text(F.col("evidence_span")).alias("text")).where("text <> ''")
    c = claims.select("session", "claim_id", F.col("sentence").alias("s"))
    # Texts meet once, however many edges and claims have them.
    pairs = _near_texts(e.select("session", "text"), c.select("session", F.col("s").alias("zt")), ["session"]).withColumnRenamed("zt", "s")
    refs = pairs.join(c, ["session", "s"]).groupBy("session", "text").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_refs"))
    one = F.count("*").over(Window.partitionBy("session", "id")) == 1
    e = e.distinct().withColumn("_one", one).join(refs, ["session", "text"])
    # An id that several edges have gets the claims of all of them.
    more = e.where("not _one").select("session", "id", F.explode_outer("claim_refs").alias("claim_id")).groupBy("session", "id").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_refs"))
    return e.where("_one").select("session", "id", "claim_refs").unionByName(more)


def assign_layer_tags(edges: DataFrame, zones: DataFrame, ontology: DataFrame) -> DataFrame:
    """Tags by glyph, by the zone of the evidence, and by the ontology."""
    text = edges.select("session", "id", evidence_text(F.col("evidence_span")).alias("text"))
    z = zone_of_text(text.where("text <> ''").select("session", "text").distinct(), zones, ["session"])
    e = edges.withColumn("text", evidence_text(F.col("evidence_span"))).join(z, ["session", "text"], "left")
    return add_ontology_tags(e.withColumn("layer_tags", first_tags(F.col("glyph"), F.col("zone_label"))), ontology).drop("text")


def refute_candidates(claims: DataFrame, limit: int = 30) -> DataFrame:
    """Pairs of claims (session, pos, claim_id, text, concepts, status) that share a concept and differ in polarity or hold opposites.

    In order of the claims, then of their ids; ``truncated`` says how many were left out. Whether two claims are a pair depends on their kinds
    alone: their concepts, polarity and opposite words. So kinds meet by an equi-join on concepts. Of a kind, only the first ``limit`` claims can begin
    one of the first ``limit`` pairs, as every partner of a claim is one of those before it; all pairs are counted by the sizes of kinds.
    """
    c = claims.where("coalesce(status, '') <> 'rejected' and session is not null and pos is not null")
    left, right = opposite_words(F.col("text"))
    k = c.select("session", "pos", "claim_id", claim_polarity(F.col("text")).alias("polarity"), left.alias("left"), right.alias("right"), F.explode("concepts").alias("concept"))
    k = k.withColumn("_n", normalize_label(F.col("concept"))).where("_n is not null")
    kind = F.array_sort(F.collect_set(F.struct("_n", "polarity", "left", "right")))  # of all rows of a claim
    c = k.groupBy("session", "pos", "claim_id").agg(kind.alias("_kind")).withColumn("kind", F.sha2(F.to_json("_kind"), 256))
    c = cut(c)
    kinds = c.groupBy("session", "kind").agg(F.any_value("_kind").alias("_kind")).select("session", "kind", F.inline("_kind"))
    c = c.drop("_kind")
    a, b = (kinds.selectExpr("session", "_n", f"kind as kind_{s}", f"polarity as polarity_{s}", f"left as left_{s}", f"right as right_{s}") for s in "ab")
    split = F.arrays_overlap("left_a", "right_b") | F.arrays_overlap("right_a", "left_b")
    met = cut(a.join(b, ["session", "_n"]).where((F.col("polarity_a") != F.col("polarity_b")) | split).select("session", "kind_a", "kind_b").distinct())
    at = lambda df, s: df.selectExpr("session", f"kind as kind_{s}", f"pos as pos_{s}", f"claim_id as {s}")
    first = c.withColumn("_r", F.row_number().over(Window.partitionBy("session", "kind").orderBy("pos", "claim_id"))).where(F.col("_r") <= limit)
    p = at(first, "a").join(met, ["session", "kind_a"]).join(at(c, "b"), ["session", "kind_b"]).where("pos_a < pos_b").select("session", "pos_a", "pos_b", "a", "b")
    w = Window.partitionBy("session").orderBy("pos_a", "pos_b", "a", "b")
    p = p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    # Pairs either way by the sizes of kinds, less those of one place, each counted twice.
    size = c.groupBy("session", "kind").agg(F.count("*").alias("n"))
    whole = met.join(size.withColumnsRenamed({"kind": "kind_a", "n": "n_a"}), ["session", "kind_a"]).join(size.withColumnsRenamed({"kind": "kind_b", "n": "n_b"}), ["session", "kind_b"]).select("session", (F.col("n_a") * F.col("n_b")).alias("n"))
    level = at(c, "a").withColumnRenamed("pos_a", "pos").join(at(c, "b").withColumnRenamed("pos_b", "pos"), ["session", "pos"]).join(met, ["session", "kind_a", "kind_b"], "left_semi").select("session", F.lit(-1).cast("long").alias("n"))
    total = whole.unionByName(level).groupBy("session").agg(F.sum("n").alias("n"))
    p = p.join(total, "session", "left").withColumn("truncated", F.greatest(F.expr("n div 2") - limit, F.lit(0)))
    return p.select("session", "pos_a", "pos_b", "a", "b", "rank", "truncated")


def refute_targets(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges that a refuted pair (session, a, b, concepts_a, concepts_b) is about: both claims on the edge, or both ends within the pair's concepts, one of them shared.

    ``edges``: session, id, claim_refs, from_norm, to_norm; joined on a claim or on an end, never by all pairs.
    """
    refs = edges.select("session", "id", F.explode("claim_refs").alias("a")).join(pairs.select("session", "a", "b"), ["session", "a"])
    refs = refs.join(edges.select("session", "id", "claim_refs"), ["session", "id"]).where(F.array_contains("claim_refs", F.col("b"))).select("session", "id", "a", "b")
    both = pairs.withColumns({"_all": F.array_union("concepts_a", "concepts_b"), "_both": F.array_intersect("concepts_a", "concepts_b")})
    near = both.select("session", "a", "b", "_all", "_both", F.explode("_all").alias("from_norm")).join(edges.select("session", "id", "from_norm", "to_norm"), ["session", "from_norm"])
    near = near.where(F.array_contains("_all", F.col("to_norm")) & (F.array_contains("_both", F.col("from_norm")) | F.array_contains("_both", F.col("to_norm"))))
    return refs.unionByName(near.select("session", "id", "a", "b")).distinct()


def stamp_refutes(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with ``refutes`` among their layer D tags where a pair refutes."""
    t = targets.select("session", "id", F.lit(True).alias("_t")).distinct()
    tagged = F.array_union(F.col("layer_tags.layer_D"), F.array(F.lit("refutes")))
    return edges.join(t, ["session", "id"], "left").withColumn("layer_tags", F.when(F.col("_t"), F.col("layer_tags").withField("layer_D", tagged)).otherwise(F.col("layer_tags"))).drop("_t")


def drop_rejected_refs(elements: DataFrame, rejected: DataFrame) -> DataFrame:
    """Elements (session, id, claim_refs, ...) without references to rejected claims; joined by claim, so no row carries a session's claims."""
    refs = elements.select("session", "id", F.explode("claim_refs").alias("claim_id"))
    hit = refs.join(rejected.select("session", "claim_id").distinct(), ["session", "claim_id"]).groupBy("session", "id").agg(F.collect_set("claim_id").alias("_r"))
    return elements.join(hit, ["session", "id"], "left").withColumn("claim_refs", F.array_except("claim_refs", F.coalesce("_r", F.array().cast("array<string>")))).drop("_r")


def neighbour_sentences(zones: DataFrame, hits: DataFrame, window: int = 1) -> DataFrame:
    """Sentences within ``window`` places of those in ``hits`` (document_id, idx) of the same document."""
    around = hits.select("document_id", F.explode(F.sequence(F.col("idx") - window, F.col("idx") + window)).alias("idx")).distinct()
    return zones.join(around, ["document_id", "idx"], "left_semi")


def distinct_sentences(sentences: DataFrame, most: int = 400) -> DataFrame:
    """The first of equal texts across documents, ``most`` in order of (document_pos, idx)."""
    one = sentences.withColumn("_r", F.row_number().over(Window.partitionBy("text").orderBy("document_pos", "idx"))).where("_r = 1").drop("_r")
    return one.orderBy("document_pos", "idx").limit(most)


def batches(rows: DataFrame, size: int, order: list[str], part: str) -> DataFrame:
    """Rows numbered within ``part`` and dealt to batches of ``size``."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1).withColumn("batch", F.floor(F.col("pos") / size))


def validated_claims(claims: DataFrame) -> DataFrame:
    return claims.where("validation.status = 'validated'")


def validation_queue(claims: DataFrame, edges: DataFrame, limit: int = 60) -> DataFrame:
    """What to validate per session, claims before causal edges, ``limit`` of them."""
    q = claims.select("session", F.lit(0).alias("kind"), F.col("claim_id").alias("id"), "pos")
    q = q.unionByName(causal_candidates(edges).select("session", F.lit(1).alias("kind"), "id", F.lit(0).alias("pos")))
    return q.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy("kind", "pos", "id"))).where(F.col("rank") <= limit)


def validate(rows: DataFrame, nli: Column | None = None, llm: Column | None = None, ontology: Column | None = None, calls: int = 16) -> DataFrame:
    """Rows (session, rank, ...) with ``validation`` from the verifiers' scores; the paid ones answer the first ``calls`` rows of a session."""
    paid = F.col("rank") <= calls
    scores = {k: F.when(paid, c) if k != "ontology" else c for k, c in (("nli", nli), ("llm", llm), ("ontology", ontology)) if c is not None}
    return rows.withColumn("validation", judge(scores or {"nli": F.lit(None).cast("double")}))


def apply_validation(edges: DataFrame, results: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges with the validation of ``results`` (session, id, validation), where there is one, and without references to rejected claims.

    No edge is removed: an unproven cause stays as a correlation.
    """
    new = results.select("session", "id", F.col("validation").alias("_v"))
    kept = F.coalesce("_v", "validation") if "validation" in edges.columns else F.col("_v")
    out = edges.join(new, ["session", "id"], "left").withColumn("validation", kept).drop("_v")
    return drop_rejected_refs(out, claims.where("validation.status = 'rejected'").select("session", "claim_id"))


def validation_counts(before: DataFrame, after: DataFrame, results: DataFrame) -> DataFrame:
    """(session, edges_validated, edges_rejected, refs_dropped) of :func:`apply_validation`."""
    hit = after.join(results.select("session", "id", F.col("validation.status").alias("_s")), ["session", "id"]).groupBy("session").agg(F.count("*").alias("edges_validated"), F.count_if(F.col("_s") == "rejected").alias("edges_rejected"))
    refs = lambda df: F.sum(F.coalesce(F.size("claim_refs"), F.lit(0)))
    lost = before.groupBy("session").agg(refs(before).alias("_b")).join(after.groupBy("session").agg(refs(after).alias("_a")), "session").select("session", (F.col("_b") - F.col("_a")).alias("refs_dropped"))
    return lost.join(hit, "session", "left").fillna(0).select("session", "edges_validated", "edges_rejected", "refs_dropped")


def dry_streaks(rounds: DataFrame, least: int = 2) -> DataFrame:
    """(session, stop): the first round that ends ``least`` rounds in a row without a find, of (session, round, found)."""
    w = Window.partitionBy("session").orderBy("round")
    r = rounds.withColumn("_island", F.sum(F.when(F.col("found") > 0, 1).otherwise(0)).over(w))
    dry = F.count_if(F.col("found") <= 0).over(Window.partitionBy("session", "_island").orderBy("round"))
    return r.withColumn("_dry", dry).where(F.col("_dry") >= least).groupBy("session").agg(F.min("round").alias("stop"))
