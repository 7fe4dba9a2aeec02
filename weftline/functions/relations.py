"""Relation semantics as columns over an edge: policy, layer tags, projection, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .text import demoted_label, edge_text, find_causal_cues, only_correlation


def is_user_origin(origin: Column) -> Column:
    return F.coalesce(origin, F.lit("")).startswith("user")


def falsy_default(x: Column, default: float) -> Column:
    """Missing and zero both count as the default."""
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, F.lit(default)).otherwise(x)


def clamp01(x: Column) -> Column:
    """Within 0..1; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def has_layer_tags(tags: Column) -> Column:
    return F.coalesce(sum((F.coalesce(F.size(tags[k]), F.lit(0)) for k in S.LAYERS), F.lit(0)) > 0, F.lit(False))


def has_tag(tags: Column, layer: str, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(tags[layer], F.array(*map(F.lit, names))), F.lit(False))


def normalize_tags(raw: Column) -> Column:
    """Tags of map<string, array<string>> in any spelling of the layer, in vocabulary order and once each; null if none is known."""
    word = lambda t: F.lower(F.regexp_replace(F.trim(t), r"[\s-]+", "_"))
    key = lambda k: F.concat(F.lit("layer_"), F.upper(F.right(F.trim(k), F.lit(1))))
    entries = F.map_entries(raw)

    def known(layer: str, vocabulary: tuple[str, ...]) -> Column:
        own = F.flatten(F.transform(F.filter(entries, lambda e: key(e["key"]) == layer), lambda e: F.transform(e["value"], word)))
        return F.array_intersect(F.array(*map(F.lit, vocabulary)), own)  # in vocabulary order, once each

    columns = {layer: known(layer, vocabulary) for layer, vocabulary in S.LAYERS.items()}
    parts = [c.alias(layer) for layer, c in columns.items()]
    made = F.struct(*parts)
    return F.when(sum((F.coalesce(F.size(p), F.lit(0)) for p in columns.values()), F.lit(0)) > 0, made)


def corroborated(override: Column, combined: Column, has_check: Column, demoted_from: Column) -> Column:
    """A user's word, else the validation score, else a causal check without demotion."""
    passed = has_check & (F.coalesce(demoted_from, F.lit("")) == "")
    return F.when(override == "allow", True).when(combined.isNotNull(), combined >= S.VALIDATED).otherwise(F.coalesce(passed, F.lit(False)))


def project_glyph(glyph: Column, origin: Column, tags: Column, backed: Column) -> Column:
    """The shown glyph from the layer tags; the order of the rules is the specification."""
    glyph = F.coalesce(F.when(glyph != "", glyph), F.lit("wave"))
    return (
        F.when(is_user_origin(origin) | ~has_layer_tags(tags), glyph)
        .when(has_tag(tags, "layer_D", "refutes"), "zigzag")
        .when(has_tag(tags, "layer_C", "causes") & backed, "arrow")
        .when(has_tag(tags, "layer_D", "questions"), "question")
        .when(has_tag(tags, "layer_C", "precedes"), "precedes")
        .when(has_tag(tags, "layer_A", "is_a"), "isa")
        .when(has_tag(tags, "layer_A", "part_of"), "partof")
        .when(has_tag(tags, "layer_D", "corroborates", "agrees_with"), "double")
        .otherwise("wave")
    )


def demoted_by_projection(projected: Column, origin: Column, tags: Column) -> Column:
    return (projected == "wave") & ~is_user_origin(origin) & has_layer_tags(tags) & has_tag(tags, "layer_C", "causes")


def with_projection(edges: DataFrame) -> DataFrame:
    """Edges with the projected glyph, its demotions recorded in causal_check, polarity filled."""
    c = F.col("causal_check")
    backed = corroborated(F.col("causal_override"), F.col("validation.combined"), c.isNotNull(), c["demoted_from"])
    out = edges.withColumn("_new", project_glyph(F.col("glyph"), F.col("origin"), F.col("layer_tags"), backed))
    down = demoted_by_projection(F.col("_new"), F.col("origin"), F.col("layer_tags"))
    back = (F.col("_new") == "zigzag") & (c["demoted_from"] == "zigzag")
    check = lambda verdict, source, reason: F.struct(c["lexicon_hit"].alias("lexicon_hit"), verdict.alias("verifier_verdict"), source.alias("demoted_from"), reason.alias("reason"))
    noted = F.when(down, check(F.coalesce(c["verifier_verdict"], F.lit("skipped")), F.lit("arrow"), F.coalesce(c["reason"], F.lit("causes without corroboration"))))
    noted = noted.when(back, check(c["verifier_verdict"], F.lit(None).cast("string"), F.lit("refutes in layer D"))).otherwise(c)
    return out.withColumns({"causal_check": noted, "glyph": F.col("_new"), "polarity": F.coalesce("polarity", F.lit("neutral"))}).drop("_new")


def apply_relation_policy(edges: DataFrame, verdict: Column | None = None, require_verifier: bool = False, enable_contradiction: bool = False, lexicon=None) -> DataFrame:
    """Causal edges need a cue, and the verifier's consent where it answers; else they become correlations.

    ``verdict``: nullable boolean, null for "did not run". ``outcome`` says what happened to each edge.
    """
    text = edge_text(F.col("evidence_span"), F.col("label"))
    glyph = F.coalesce("glyph", F.lit("arrow"))
    hits = F.when(glyph == "arrow", find_causal_cues(text, lexicon))  # the others need none
    override, verdict = F.col("causal_override"), F.lit(None).cast("boolean") if verdict is None else verdict
    out = edges.withColumns({"_hits": hits, "_text": text, "_v": verdict, "_g": glyph})
    arrow, v = F.col("_g") == "arrow", F.col("_v")
    outcome = (
        F.when(arrow & (override == "allow"), "override_allow")
        .when(arrow & (override == "deny"), "override_deny")
        .when(arrow & (F.size("_hits") == 0), "no_cue")
        .when(arrow & v.isNull() & F.lit(require_verifier), "no_verifier")
        .when(arrow & (v == F.lit(False)), "refused")
        .when(arrow, "kept")
        .when((F.col("_g") == "zigzag") & F.lit(not enable_contradiction), "contradiction_demoted")
        .otherwise("unchanged")
    )
    out = out.withColumn("outcome", outcome)
    down = F.col("outcome").isin("override_deny", "no_cue", "no_verifier", "refused")
    said = F.when(v, "pass").when(v == F.lit(False), "fail").otherwise("skipped")
    said = F.when(F.col("outcome").isin("kept", "refused"), said).otherwise("skipped")
    reason = F.when((F.col("outcome") == "no_cue") & only_correlation(F.col("_text")), "correlation only").otherwise(F.col("outcome"))
    check = F.struct(F.when(F.col("_g") == "arrow", F.col("_hits")).alias("lexicon_hit"), said.alias("verifier_verdict"), F.when(down | (F.col("outcome") == "contradiction_demoted"), F.col("_g")).alias("demoted_from"), reason.alias("reason"))
    old = F.col("causal_check") if "causal_check" in edges.columns else F.lit(None).cast("struct<lexicon_hit:array<string>,verifier_verdict:string,demoted_from:string,reason:string>")
    return out.withColumns(
        {
            "causal_check": F.when(F.col("outcome") != "unchanged", check).otherwise(old),
            "glyph": F.when(down, "wave").when(F.col("outcome") == "contradiction_demoted", "tension").otherwise(F.col("_g")),
            "label": F.when(down, demoted_label(F.col("label"))).otherwise(F.col("label")),
        }
    ).drop("_hits", "_text", "_v", "_g")


def policy_stats(edges: DataFrame) -> DataFrame:
    """Counts of the outcomes of :func:`apply_relation_policy`."""
    o = F.col("outcome")
    return edges.agg(
        F.count_if(o.isin("kept", "override_allow")).alias("causal_kept"),
        F.count_if(o.isin("override_deny", "no_cue", "no_verifier", "refused")).alias("causal_demoted"),
        F.count_if(o == "contradiction_demoted").alias("contradiction_demoted"),
        F.count_if(o == "unchanged").alias("unchanged"),
        F.count_if(o == "override_allow").alias("override_allow"),
        F.count_if(o == "override_deny").alias("override_deny"),
    )


def combine_scores(scores: dict[str, Column]) -> Column:
    """Weighted mean of the verifiers that ran; null if none did."""
    total = sum((F.when(c.isNotNull(), S.VERIFIER_WEIGHTS[k]).otherwise(0.0) for k, c in scores.items()), F.lit(0.0))
    weighted = sum((F.coalesce(clamp01(c) * S.VERIFIER_WEIGHTS[k], F.lit(0.0)) for k, c in scores.items()), F.lit(0.0))
    return F.round(F.when(total > 0, weighted / total), 4)


def judge(scores: dict[str, Column]) -> Column:
    """struct(status, combined, requires_human_review); the ontology alone never validates, no answer is uncertain."""
    combined = combine_scores(scores)
    others = [c for k, c in scores.items() if k != "ontology"]
    spoken = F.coalesce(*others).isNotNull() if others else F.lit(False)
    status = F.when(combined.isNull(), "uncertain").when((combined >= S.VALIDATED) & spoken, "validated").when(combined >= S.UNCERTAIN, "uncertain").otherwise("rejected")
    return F.struct(status.alias("status"), combined.alias("combined"), (status == "uncertain").alias("requires_human_review"))


def blend(base: Column, confidence: Column) -> Column:
    """A label's base score drawn towards 0.5 by missing confidence."""
    return 0.5 + (base - 0.5) * clamp01(confidence)


def causal_candidates(edges: DataFrame) -> DataFrame:
    """Edges to validate: causal ones, and correlations that were demoted from causal."""
    return edges.where(~is_user_origin(F.col("origin")) & ((F.col("glyph") == "arrow") | ((F.col("glyph") == "wave") & (F.col("causal_check.demoted_from") == "arrow"))))
