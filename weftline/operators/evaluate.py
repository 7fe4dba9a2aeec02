"""Evaluation: indicators from click logs, judgements against the current graph, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relations import is_user_origin

ERROR_TARGET, SATISFACTION_TARGET, EVIDENCE_TARGET = 0.30, 0.60, 0.95
ACCURACY_TARGET, CAUSAL_TARGET, GAP_TARGET = 0.70, 0.70, 0.40
RELATION_GOLD, GAP_GOLD = 150, 50


def share(num: Column, den: Column, digits: int = 3) -> Column:
    """num / den, null where den is 0: missing is not zero."""
    return F.round(F.try_divide(num, den), digits)


def relation_error_rate(sessions: DataFrame) -> DataFrame:
    """Incorrect among decided verdicts."""
    v = sessions.select(F.explode("relation_verdicts").alias("edge_id", "verdict"))
    bad, good = F.count_if(F.col("verdict") == "incorrect"), F.count_if(F.col("verdict") == "correct")
    return v.agg(bad.alias("incorrect"), good.alias("correct"), F.count_if(F.col("verdict") == "undecidable").alias("undecidable"), share(bad, bad + good).alias("error_rate"), (F.try_divide(bad, bad + good) <= ERROR_TARGET).alias("meets_target"))


def satisfaction(sessions: DataFrame) -> DataFrame:
    n, high = F.count("satisfaction"), F.count_if(F.col("satisfaction") >= 4)
    return sessions.agg(n.alias("n"), F.round(F.avg("satisfaction"), 3).alias("mean"), share(high, n).alias("share_4_plus"), (F.try_divide(high, n) >= SATISFACTION_TARGET).alias("meets_target"))


def correction_rate(sessions: DataFrame, ops: tuple[str, ...] = ("delete_node", "rename_node", "delete_edge", "retype_edge", "relabel_edge", "reverse_edge")) -> DataFrame:
    """Correcting operations per map."""
    n = F.size(F.filter(F.coalesce("operations", F.array().cast("array<struct<op:string,at:string>>")), lambda o: o["op"].isin(*ops)))
    total = F.sum(n)
    return sessions.agg(F.count("*").alias("maps"), F.coalesce(total, F.lit(0)).alias("corrections"), share(total, F.count("*")).alias("per_map"))


def evidence_display_rate(edges: DataFrame) -> DataFrame:
    """Share of extracted relations with a span."""
    e = edges.where(~is_user_origin(F.col("origin")))
    k = F.count_if(F.size("evidence_span") > 0)
    return e.agg(F.count("*").alias("relations"), k.alias("with_evidence"), share(k, F.count("*")).alias("rate"), (F.try_divide(k, F.count("*")) >= EVIDENCE_TARGET).alias("meets_target"))


def causal_funnel(edges: DataFrame) -> DataFrame:
    """Candidates, kept, demoted, verified and their coverage; user edges are counted apart."""
    user = is_user_origin(F.col("origin"))
    kept = ~user & (F.col("glyph") == "arrow")
    demoted = ~user & (F.coalesce("causal_check.demoted_from", F.lit("")) == "arrow")
    verified = (kept | demoted) & F.coalesce("causal_check.verifier_verdict", F.lit("")).isin("pass", "fail")
    n = F.count_if(kept | demoted)
    return edges.agg(n.alias("candidates"), F.count_if(kept).alias("kept"), F.count_if(demoted).alias("demoted"), F.count_if(verified).alias("verified"), share(F.count_if(verified), n).alias("coverage"), F.count_if(user).alias("user_excluded"))


def summarize(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with all indicators."""
    out = relation_error_rate(sessions).select("error_rate")
    for df in (satisfaction(sessions).select("share_4_plus"), correction_rate(sessions).select("per_map"), evidence_display_rate(edges).select(F.col("rate").alias("evidence_rate")), causal_funnel(edges).select("candidates", "kept", "demoted")):
        out = out.join(df)
    return out


def latest_wins(labels: DataFrame, key: list[str]) -> DataFrame:
    """One judgement per key: the last by (ts, seq); a missing ts loses."""
    order = Window.partitionBy(*key).orderBy(F.desc(F.coalesce("ts", F.lit(""))), F.desc("seq"))
    return labels.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def match_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Judgements with the edge of the current graph that they mean and a status: matched, user_origin or missing.

    By (session, edge_id), else by the pair of normalised labels: in the same session, else in the newest one. What two
    keys resolve to the same edge is judged by the later one again. ``edges``: session, edge_id, from_norm, to_norm, glyph, origin.
    """
    e = edges.select("session", "edge_id", "from_norm", "to_norm", "glyph", is_user_origin(F.col("origin")).alias("user"))
    out = labels.join(e.select("session", "edge_id", F.struct("glyph", "user").alias("by_id")), ["session", "edge_id"], "left")
    # Null keys meet nothing; said once here, so that both joins below read the same aggregate and edges are moved once for them.
    known = e.where("session is not null and edge_id is not null and from_norm is not null and to_norm is not null")
    own = known.groupBy("from_norm", "to_norm", "session").agg(F.min(F.struct("edge_id", "glyph", "user")).alias("own"))
    new = own.groupBy("from_norm", "to_norm").agg(F.max(F.struct("session", "own")).alias("new"))
    out = out.join(own, ["from_norm", "to_norm", "session"], "left").join(new, ["from_norm", "to_norm"], "left")
    row = lambda session, edge_id, x: F.when(F.col(x).isNotNull(), F.struct(session.alias("session"), edge_id.alias("edge_id"), F.col(f"{x}.glyph").alias("glyph"), F.col(f"{x}.user").alias("user")))
    found = F.coalesce(row(F.col("session"), F.col("edge_id"), "by_id"), row(F.col("session"), F.col("own.edge_id"), "own"), row(F.col("new.session"), F.col("new.own.edge_id"), "new.own"))
    out = out.withColumn("row", found).drop("by_id", "own", "new")
    status = F.when(F.col("row").isNull(), "missing").when(F.col("row.user"), "user_origin").otherwise("matched")
    out = out.withColumns({"status": status, "m_session": F.coalesce("row.session", "session"), "m_edge_id": F.coalesce("row.edge_id", "edge_id"), "glyph": F.col("row.glyph")}).drop("row")
    ident = F.when(F.col("status") == "missing", F.concat_ws("|", F.lit("?"), "session", "edge_id", "from_norm", "to_norm")).otherwise(F.concat_ws("|", F.lit("!"), "m_session", "m_edge_id"))
    order = Window.partitionBy("_i").orderBy(F.desc(F.coalesce("ts", F.lit(""))), F.desc("seq"))
    return out.withColumn("_i", ident).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_i", "_r")


def offline_metrics(matched: DataFrame, total_relations: int) -> DataFrame:
    """Accuracy, causal precision and coverage over matched judgements; null where nothing was judged."""
    use = F.col("status") == "matched"
    ok, bad = F.count_if(use & (F.col("verdict") == "correct")), F.count_if(use & (F.col("verdict") == "incorrect"))
    arrow = use & (F.col("glyph") == "arrow") & F.col("causal_ok").isNotNull()
    n, total = F.count_if(use), F.lit(total_relations)
    return matched.agg(
        share(ok, ok + bad).alias("relation_accuracy"), (F.try_divide(ok, ok + bad) >= ACCURACY_TARGET).alias("accuracy_met"),
        share(F.count_if(arrow & F.col("causal_ok")), F.count_if(arrow)).alias("causal_precision"), F.count_if(arrow).alias("causal_judged"),
        n.alias("judged_relations"), share(n, total).alias("coverage"), F.round(F.least(F.lit(1.0), F.count("*") / RELATION_GOLD), 3).alias("gold_progress"),
        F.count_if(F.col("status") == "user_origin").alias("user_origin"), F.count_if(F.col("status") == "missing").alias("missing"),
    )


def merge_gaps(plan: DataFrame, gold: DataFrame) -> DataFrame:
    """Gaps of the plans and of the gold files by (session, gap_id); gold wins."""
    both = plan.select("session", "gap_id", "status", F.lit(1).alias("_p")).unionByName(gold.select("session", "gap_id", F.when(F.col("decision") == "confirm", "confirmed").otherwise("dismissed").alias("status"), F.lit(0).alias("_p")))
    return both.groupBy("session", "gap_id").agg(F.min_by("status", "_p").alias("status"))


def unlabeled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Extracted relations that nobody judged, by id or by labels."""
    e = edges.where(~is_user_origin(F.col("origin")))
    e = e.join(labels.where("session is not null and edge_id is not null").select("session", "edge_id").distinct(), ["session", "edge_id"], "left_anti")
    return e.join(labels.where("from_norm <> '' and to_norm <> ''").select("from_norm", "to_norm").distinct(), ["from_norm", "to_norm"], "left_anti")


def stratified(pool: DataFrame, k: int, stratum: str = "glyph") -> DataFrame:
    """``k`` rows by largest remainder over the strata, in each the newest session and last id first."""
    size = pool.groupBy(stratum).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(1))
    exact = F.col("n") * k / F.sum("n").over(one)
    q = size.withColumns({"base": F.floor(exact), "rest": exact - F.floor(exact), "total": F.sum("n").over(one)})
    q = q.withColumn("left", F.lit(k) - F.sum("base").over(one))
    rank = F.row_number().over(one.orderBy(F.desc("rest"), F.desc("n"), stratum))
    q = q.withColumn("quota", F.when(F.col("total") <= k, F.col("n")).otherwise(F.least(F.col("n"), F.col("base") + F.when(rank <= F.col("left"), 1).otherwise(0)))).select(stratum, "quota")
    order = Window.partitionBy(stratum).orderBy(F.desc("session"), F.desc("edge_id"))
    # A stratum has k rows at most, so that the sort is cut to them before the join.
    return pool.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).join(q, stratum).where("_r <= quota").drop("_r", "quota")


def daily_usage(rows: DataFrame, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """Per day and in total (day null): tokens, calls, runs, cached runs, runs of unknown use; cost per million if priced."""
    out = rows.withColumn("day", F.left("ts", F.lit(10))).rollup("day").agg(
        F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("calls").alias("calls"), F.count("*").alias("runs"), F.count_if("cached").alias("cached"), F.count_if(F.col("input").isNull()).alias("unknown")
    )
    if price_in is None or price_out is None:
        return out
    return out.withColumn("cost", F.round((F.col("input") * price_in + F.col("output") * price_out) / 1e6, 6))


def usage_totals(responses: DataFrame, by: list[str]) -> DataFrame:
    """Accumulated use of single responses; one without figures counts as unknown, not as zero."""
    return responses.groupBy(*by).agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.count("*").alias("calls"), F.count_if(F.col("input").isNull() | F.col("output").isNull()).alias("unknown"))


def offline_eval(labels: DataFrame, edges: DataFrame, queue: int = 10) -> dict[str, DataFrame]:
    """Latest judgements, matches, metrics and the queue of what to judge next."""
    latest = latest_wins(labels, ["session", "edge_id", "from_norm", "to_norm"])
    matched = match_labels(latest, edges)
    return {"matched": matched, "metrics": offline_metrics(matched, edges.count()), "queue": stratified(unlabeled(edges, latest), queue)}


def save_evaluation(metrics: DataFrame, path: str, today: str) -> None:
    """The indicators of a day below ``path``, beside those of other days."""
    metrics.write.mode("overwrite").json(f"{path}/day={today}")
