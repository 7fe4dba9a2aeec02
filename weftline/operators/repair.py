"""Repair of extracted graphs: ids, labels, enums, spans, references; merging of fragments. Every repair is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.relations import clamp01
from ..functions.text import normalize_label

MAX_NODES = 100


def with_ids(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows (session, pos, id): a missing id becomes ``prefix`` and the position, a repeated one gets ``-pos``; ``id_repair`` says so."""
    made = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", F.concat(F.lit(prefix), F.lpad(F.col("pos").cast("string"), 3, "0")))
    r = rows.withColumns({"_m": made.isNotNull(), "id": F.coalesce(made, "id")})
    n = F.row_number().over(Window.partitionBy("session", "id").orderBy("pos"))
    r = r.withColumn("_n", n)
    kind = F.when(F.col("_m"), "missing").when(F.col("_n") > 1, "duplicate")
    return r.withColumns({"id_repair": kind, "id": F.when(F.col("_n") > 1, F.concat_ws("-", "id", F.col("pos").cast("string"))).otherwise(F.col("id"))}).drop("_m", "_n")


def split_dangling(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) edges: dropped are self loops and those with an end that does not exist."""
    ids = nodes.select("session", "id").distinct()
    e = edges
    for end in ("from", "to"):
        e = e.join(ids.select("session", F.col("id").alias(end), F.lit(True).alias(f"_{end}")), ["session", end], "left")
    ok = F.col("_from").isNotNull() & F.col("_to").isNotNull() & (F.col("from") != F.col("to"))
    why = F.when(F.col("from") == F.col("to"), "self_loop").otherwise("dangling")
    return e.where(ok).drop("_from", "_to"), e.where(~F.coalesce(ok, F.lit(False))).withColumn("repair", why).drop("_from", "_to")


def enum(value: Column, allowed: tuple[str, ...], default: str | None) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default).cast("string"))


def clamp_confidence(raw: Column) -> Column:
    """A number within 0..1; null if it is none."""
    return clamp01(raw.try_cast("double"))


def undefined_communities(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """Communities that nodes name and nobody defines, named by their id."""
    used = nodes.select("session", F.coalesce("community_id", F.lit("comm_000")).alias("id")).distinct()
    return used.join(communities.select("session", "id"), ["session", "id"], "left_anti").withColumns({"name": F.col("id"), "is_gap": F.lit(False)})


def evidence_spans(raw: Column) -> Column:
    """Spans from JSON text: an object, a string or a list of either; camelCase names; half-open ranges lose their offsets; empty ones go."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    listed = F.when(kind.startswith("ARRAY"), raw).when(kind.startswith("OBJECT"), F.concat(F.lit("["), raw, F.lit("]"))).when(kind == "STRING", F.concat(F.lit("["), raw, F.lit("]")))
    items = F.from_json(listed, "array<string>")
    g = lambda x, *names: F.coalesce(*(F.get_json_object(x, f"$.{n}") for n in names))

    def one(x: Column) -> Column:
        a, b = g(x, "char_start", "charStart").try_cast("int"), g(x, "char_end", "charEnd").try_cast("int")
        whole = a.isNotNull() & b.isNotNull() & (a < b)
        obj = x.startswith("{")
        return F.struct(
            F.when(obj, g(x, "document_id", "documentId", "doc")).alias("document_id"), F.when(obj & whole, a).alias("char_start"), F.when(obj & whole, b).alias("char_end"),
            F.when(obj, g(x, "surface", "text")).otherwise(x).alias("surface"),
        )

    spans = F.filter(F.transform(items, one), lambda s: (F.coalesce(F.trim(s["surface"]), F.lit("")) != "") | s["char_start"].isNotNull())
    return F.coalesce(spans, F.array().cast(S.SPANS))


def claim_refs(raw: Column) -> Column:
    """References from JSON text: a string or a list, strings only, once each."""
    v = F.try_parse_json(raw)
    items = F.when(F.schema_of_variant(v) == "STRING", F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw)
    # Elements that are no strings are told by their JSON text.
    strings = F.transform(F.regexp_extract_all(items, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1), lambda x: x)
    return F.array_distinct(F.filter(F.coalesce(strings, F.array().cast("array<string>")), lambda x: x != ""))


def normalize_nodes(raw: DataFrame) -> DataFrame:
    """Nodes (session, pos, id, label, community_id, ...) with ids, labels and communities filled."""
    n = with_ids(raw, "c")
    return n.withColumns({"label": F.coalesce(F.when(F.trim("label") != "", F.trim("label")), "id"), "community_id": F.coalesce(F.when(F.col("community_id") != "", F.col("community_id")), F.lit("comm_000"))})


def normalize_edges(nodes: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dropped): ids filled, ends checked, glyph, status and confidence within their vocabularies."""
    kept, dropped = split_dangling(nodes, with_ids(raw, "r"))
    kept = kept.withColumns(
        {
            "glyph_repair": ~F.coalesce(F.col("glyph").isin(*S.GLYPHS), F.lit(False)),
            "glyph": enum(F.col("glyph"), S.GLYPHS, "wave"),
            "epistemic_status": enum(F.col("epistemic_status"), S.EPISTEMIC, None),
            "confidence": clamp_confidence(F.col("confidence")),
            "label": F.coalesce("label", F.lit("")),
        }
    )
    return kept, dropped


def repair_counts(nodes: DataFrame, edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """(session, repair, n) of everything that was changed."""
    parts = [
        nodes.where("id_repair is not null").select("session", F.concat(F.lit("node_id_"), "id_repair").alias("repair")),
        edges.where("id_repair is not null").select("session", F.concat(F.lit("edge_id_"), "id_repair").alias("repair")),
        edges.where("glyph_repair").select("session", F.lit("glyph").alias("repair")),
        dropped.select("session", "repair"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("session", "repair").agg(F.count("*").alias("n"))


def merge_spans(a: Column, b: Column) -> Column:
    """Union of spans by document, surface and place."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast(S.SPANS)), F.coalesce(b, F.array().cast(S.SPANS))))


def merge_duplicate_edges(edges: DataFrame, norm=normalize_label) -> DataFrame:
    """Edges that agree in ends, glyph and normalised label become one with all spans; the first id stays."""
    e = edges.withColumn("_l", norm(F.col("label")))
    spans = F.array_distinct(F.flatten(F.collect_list(F.coalesce("evidence_span", F.array().cast(S.SPANS)))))
    return e.groupBy("session", "from", "to", "glyph", "_l").agg(F.min("id").alias("id"), F.min_by("label", "id").alias("label"), F.max("confidence").alias("confidence"), spans.alias("evidence_span"), F.count("*").alias("merged")).drop("_l")


def resolve_ends(edges: DataFrame, known: DataFrame, norm=normalize_label) -> DataFrame:
    """Edges whose ends are ids or labels of known nodes (session, id, label), by id first; unresolved ones are dropped."""
    by_label = known.withColumn("_n", norm(F.col("label"))).groupBy("session", "_n").agg(F.min("id").alias("_via"))
    out = edges
    for end in ("from", "to"):
        ids = known.select("session", F.col("id").alias(end), F.col("id").alias("_id"))
        out = out.join(ids, ["session", end], "left").withColumn("_n", norm(F.col(end))).join(by_label, ["session", "_n"], "left")
        out = out.withColumn(end, F.coalesce("_id", "_via")).drop("_id", "_via", "_n")
    return out.where("`from` is not null and `to` is not null and `from` <> `to`")


def merge_fragment(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, most: int = MAX_NODES, norm=normalize_label) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mapping): a fragment merged by normalised label; unknown labels get free ids in order of arrival up to ``most`` nodes.

    ``mapping`` (session, fragment id, id) lacks what did not fit; edges to such nodes are dropped.
    """
    known = nodes.withColumn("_n", norm(F.col("label")))
    frag = new_nodes.withColumn("_n", norm(F.col("label"))).where("_n <> ''")
    first = frag.groupBy("session", "_n").agg(F.min_by(F.struct("label", "community_id"), "pos").alias("x"), F.min("pos").alias("pos"))
    fresh = first.join(known.select("session", "_n"), ["session", "_n"], "left_anti")
    have = known.groupBy("session").agg(F.count("*").alias("k"), F.coalesce(F.max(F.regexp_extract("id", r"^c(\d+)$", 1).try_cast("int")), F.lit(-1)).alias("top"))
    fresh = fresh.join(have, "session", "left").fillna({"k": 0, "top": -1}).withColumn("_r", F.row_number().over(Window.partitionBy("session").orderBy("pos"))).where(F.col("_r") + F.col("k") <= most)
    added = fresh.select("session", F.concat(F.lit("c"), F.lpad((F.col("top") + F.col("_r")).cast("string"), 3, "0")).alias("id"), "x.label", "x.community_id", "_n")
    all_nodes = known.select("session", "id", "label", "community_id", "_n").unionByName(added)
    mapping = frag.select("session", F.col("id").alias("fragment_id"), "_n").join(all_nodes.groupBy("session", "_n").agg(F.min("id").alias("id")), ["session", "_n"]).drop("_n")
    e = new_edges
    for end in ("from", "to"):
        e = e.join(mapping.select("session", F.col("fragment_id").alias(end), F.col("id").alias("_id")), ["session", end]).withColumn(end, F.col("_id")).drop("_id")
    cols = ["session", "id", "from", "to", "glyph", "label", "confidence", "evidence_span"]
    merged = merge_duplicate_edges(edges.select(cols).unionByName(e.where("`from` <> `to`").select(cols)), norm)
    return all_nodes.drop("_n"), merged, mapping


def repair_zones(raw: DataFrame, batch: DataFrame) -> DataFrame:
    """Zone answers (sentence_id, zone_label, confidence) for known sentences with known labels, confidence 0.5 by default."""
    names = {x.lower(): (x, "AZ") for x in S.AZ} | {x.lower(): (x, "CoreSC") for x in S.CORESC}
    low = F.lower(F.trim("zone_label"))
    pick = lambda i: F.coalesce(*(F.when(low == k, v[i]) for k, v in names.items()))
    z = raw.join(batch.select("sentence_id"), "sentence_id", "left_semi")
    return z.select("sentence_id", pick(0).alias("zone_label"), pick(1).alias("zone_system"), clamp01(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5))).alias("confidence")).where("zone_label is not null")


def repair_concepts(raw: DataFrame, concepts: DataFrame, norm=normalize_label) -> DataFrame:
    """Concept mentions (key, pos, concept) mapped to existing labels; unknown ones are dropped."""
    index = concepts.withColumn("_n", norm(F.col("label"))).groupBy("_n").agg(F.min_by("label", "pos").alias("label"))
    return raw.withColumn("_n", norm(F.col("concept"))).join(index, "_n").select("key", "pos", F.col("label").alias("concept")).dropDuplicates(["key", "concept"])


def repair_ontology(raw: DataFrame) -> DataFrame:
    """Classes within the vocabulary (UNKNOWN else), relations is_a and part_of only."""
    low = F.lower(F.regexp_replace(F.trim("onto_class"), "(?i)^bfo:", ""))
    cls = F.coalesce(*(F.when(low == c.lower(), f"bfo:{c}") for c in S.ONTO_CLASSES), F.lit("UNKNOWN"))
    return raw.withColumn("onto_class", cls)


def repair_refs(raw: DataFrame, known: DataFrame, key: str, ref: str) -> DataFrame:
    """Answers (key, refs) with the references that exist; hallucinated ones are dropped."""
    flat = raw.select(key, F.posexplode(ref).alias("_p", "r")).join(known.select(F.col("ref").alias("r")), "r", "left_semi")
    kept = flat.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_p", "r"))), lambda x: x["r"])).alias(ref))
    return raw.drop(ref).join(kept, key, "left").withColumn(ref, F.coalesce(ref, F.array().cast("array<string>")))


def repair_verdicts(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verdicts by position for pairs; a batch whose count differs is discarded as a whole, unknown verdicts become none."""
    n = pairs.groupBy("batch").agg(F.count("*").alias("k")).join(raw.groupBy("batch").agg(F.count("*").alias("got")), "batch").where("k = got")
    low = F.lower(F.trim("verdict"))
    v = F.when(low.isin("refutes", "disagrees", "none"), low).otherwise("none")
    return pairs.join(n.select("batch"), "batch", "left_semi").join(raw.select("batch", "pos", v.alias("verdict"), clamp01(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5))).alias("confidence")), ["batch", "pos"])
