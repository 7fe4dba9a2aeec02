"""Streaming forms of the append-only logs; each equals its batch form once all input is read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_usage(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Usage (ts timestamp, input, output, calls) per day, with a watermark for late rows."""
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    return w.agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.count("*").alias("runs")).select(F.to_date("window.start").alias("day"), "input", "output", "runs")


def event_counts(rows: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events (ts, event_type, value) per window and type."""
    g = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def latest_verdicts(rows: DataFrame) -> DataFrame:
    """The last verdict (map_id, edge_id, verdict, ts string, seq) per map and edge: state of one row per key."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else ("", -1, None)
        for pdf in pdfs:
            for r in pdf.itertuples():
                best = max(best, (r.ts or "", int(r.seq), r.verdict), key=lambda x: x[:2])
        state.update(best)
        yield pd.DataFrame({"map_id": [key[0]], "edge_id": [key[1]], "ts": [best[0]], "seq": [best[1]], "verdict": [best[2]]})

    return rows.groupBy("map_id", "edge_id").applyInPandasWithState(step, "map_id string, edge_id string, ts string, seq long, verdict string", "ts string, seq long, verdict string", "update", GroupStateTimeout.NoTimeout)


def edit_counts(rows: DataFrame) -> DataFrame:
    """Effective edits per session (session, edit_id, op, target): state of the ids seen and reverted, as the fold needs them."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, dead = (set(x) for x in state.get) if state.exists else (set(), set())
        for pdf in pdfs:
            for r in pdf.itertuples():
                (dead if r.op == "revert" else ids).add(r.target if r.op == "revert" else r.edit_id)
        state.update((sorted(ids), sorted(dead)))
        yield pd.DataFrame({"session": [key[0]], "effective": [len(ids - dead)], "reverted": [len(ids & dead)]})

    return rows.groupBy("session").applyInPandasWithState(step, "session string, effective long, reverted long", "ids array<string>, dead array<string>", "update", GroupStateTimeout.NoTimeout)


def live_cache(rows: DataFrame, minutes: int = 360) -> DataFrame:
    """Cache entries (key, created timestamp, entry), each once: keys are forgotten after their time to live."""
    return rows.withWatermark("created", f"{minutes} minutes").dropDuplicatesWithinWatermark(["key"])


def run_all(spark: SparkSession, stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything that is available now, as Parquet beside the checkpoint, a folder for each batch; the driver holds none of it.

    A batch that is run again replaces its folder; in mode ``complete`` each replaces the one before.
    """
    paths: list[str] = []

    def keep(rows: DataFrame, batch: int) -> None:
        path = f"{checkpoint.rstrip('/')}-rows/{0 if mode == 'complete' else batch}"
        rows.write.mode("overwrite").parquet(path)
        paths.append(path)

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*sorted(set(paths))) if paths else spark.createDataFrame([], stream.schema)
