"""Streaming operators with state of their own: the fold of an edit log, and a cache whose entries expire.

Both use ``transformWithState`` (RocksDB state); once all input is read they equal their batch forms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.editlog import Graph, _norm
from . import logs

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A row of the input of the fold: a node or edge of the base graph, or an edit (then ``id`` is the edit's).
FOLD_INPUT = "session string, kind string, id string, label string, community_id string, src string, dst string, glyph string, origin string, op string, target string, payload string, seq long"
_ELEMENT = "label string, community_id string, src string, dst string, glyph string, origin string"
#: A change: the row as it is now, or gone; the last change by ``version`` counts.
FOLD_OUTPUT = f"session string, kind string, id string, {_ELEMENT}, gone boolean, version long"
_FOLD_COLUMNS = [c.split()[0] for c in FOLD_OUTPUT.split(", ")]
#: ``created`` in microseconds.
CACHE_OUTPUT = "owner string, id string, created long, live boolean"
_ENTRIES = pa.schema([("owner", pa.string()), ("id", pa.string()), ("created", pa.int64())])
#: Shards of the owners of a cache; a task holds the entries of one at a time.
SHARDS = 512


def fold_input(nodes: DataFrame, edges: DataFrame, edits: DataFrame) -> DataFrame:
    """The three tables as rows of :data:`FOLD_INPUT`; each may be a stream."""
    null = "cast(null as string)"
    n = nodes.selectExpr("session", "'node' as kind", "id", "label", "community_id", f"{null} as src", f"{null} as dst", f"{null} as glyph", "origin", f"{null} as op", f"{null} as target", f"{null} as payload", "0L as seq")
    e = edges.selectExpr("session", "'edge' as kind", "id", "label", f"{null} as community_id", "`from` as src", "`to` as dst", "glyph", "origin", f"{null} as op", f"{null} as target", f"{null} as payload", "0L as seq")
    d = edits.selectExpr("session", "'edit' as kind", "edit_id as id", f"{null} as label", f"{null} as community_id", f"{null} as src", f"{null} as dst", f"{null} as glyph", f"{null} as origin", "op", "target", "to_json(payload) as payload", "cast(seq as long) as seq")
    return n.unionByName(e).unionByName(d)


def _rows(g: Graph) -> dict[tuple[str, str], tuple]:
    """The elements of a graph by kind and id."""
    out = {("node", n["id"]): (n["label"], n["community_id"], None, None, None, n["origin"]) for n in g.nodes.values()}
    out |= {("edge", e["id"]): (e["label"], None, e["from"], e["to"], e["glyph"], e["origin"]) for e in g.edges.values()}
    return out | {("warning", f"w{i:04d}"): (w, None, None, None, None, None) for i, w in enumerate(g.warnings)}


def _graph(rows: dict[tuple[str, str], tuple]) -> Graph:
    nodes = [{"id": i, "label": v[0], "norm": _norm(v[0]), "community_id": v[1], "origin": v[5]} for (k, i), v in rows.items() if k == "node"]
    edges = [{"id": i, "from": v[2], "to": v[3], "label": v[0], "glyph": v[4], "origin": v[5]} for (k, i), v in rows.items() if k == "edge"]
    g = Graph(nodes, edges)
    g.warnings = [v[0] for (k, _), v in sorted(rows.items()) if k == "warning"]
    return g


class Fold(StatefulProcessor):
    """One session: its base graph, its edits, its reverted ids and the present graph, each as map state.

    Edits that go on from the last one are applied to the present graph. A base element, an edit that comes out of order, or a revert of one
    that was applied makes the session fold its base anew. Only what changed is written and emitted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        key, element = "kind string, id string", _ELEMENT
        self.base = handle.getMapState("base", key, element)
        self.graph = handle.getMapState("graph", key, element)
        self.log = handle.getMapState("log", "seq long, id string", "op string, target string, payload string")
        self.dead = handle.getMapState("dead", "id string", "seq long")
        self.last = handle.getValueState("last", "seq long, id string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]
        seq, last_id, version = self.last.get() if self.last.exists() else (-1, "", 0)
        anew, edits = False, []
        for r in new:
            if r["kind"] != "edit":
                self.base.updateValue((r["kind"], r["id"]), (r["label"], r["community_id"], r["src"], r["dst"], r["glyph"], r["origin"]))
                anew = True
            elif r["op"] == "revert":
                if r["target"] is not None:
                    self.dead.updateValue((r["target"],), (r["seq"],))
                    anew = True
            else:
                self.log.updateValue((r["seq"], r["id"]), (r["op"], r["target"], r["payload"]))
                anew = anew or (r["seq"], r["id"]) <= (seq, last_id)
                edits.append((r["seq"], r["id"], r["op"], r["target"], r["payload"]))
        before = {tuple(k): tuple(v) for k, v in self.graph.iterator()}
        if anew:
            g = _graph({tuple(k): tuple(v) for k, v in self.base.iterator()})
            edits = [(*k, *v) for k, v in self.log.iterator()]
        else:
            g = _graph(before)
        for s, i, op, target, payload in sorted(edits, key=lambda x: x[:2]):
            if not self.dead.containsKey((i,)):
                g.apply(i, op, target, json.loads(payload or "{}"))
            seq, last_id = max((seq, last_id), (s, i))
        after = _rows(g)
        self.last.update((seq, last_id, version + 1))
        out = []
        for k in sorted({*before, *after}):
            if k not in after:
                self.graph.removeKey(k)
                out.append((key[0], *k, *before[k], True, version))
            elif before.get(k) != after[k]:
                self.graph.updateValue(k, after[k])
                out.append((key[0], *k, *after[k], False, version))
        yield pd.DataFrame(out, columns=_FOLD_COLUMNS)

    def close(self) -> None:
        pass


def folded(rows: DataFrame) -> DataFrame:
    """Changes (see :data:`FOLD_OUTPUT`) of the graphs of all sessions from a stream of :data:`FOLD_INPUT`."""
    return rows.groupBy("session").transformWithStateInPandas(Fold(), FOLD_OUTPUT, "Update", "None")


def current(changes: DataFrame) -> DataFrame:
    """The graph that a table of changes leaves, with the columns of the batch fold."""
    last = F.row_number().over(Window.partitionBy("session", "kind", "id").orderBy(F.desc("version")))
    out = changes.withColumn("_r", last).where("_r = 1 and not gone")
    return out.select("session", "kind", "id", "label", "community_id", F.col("src").alias("from"), F.col("dst").alias("to"), "glyph", "origin")


class Expiring(StatefulProcessor):
    """The live entries of the owners of a shard as one Arrow table, and one timer for the first that expires; the watermark lags by the time to live.

    Every call of the state goes to the JVM and back, and so does every group of rows. So owners share a shard, whose table is read and written
    as a whole, once for each batch in which it has rows or expiring entries.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "data binary")

    def _known(self) -> pd.DataFrame:
        if not self.entries.exists():
            return pd.DataFrame({"owner": pd.Series(dtype=object), "id": pd.Series(dtype=object), "created": pd.Series(dtype="int64")})
        return pa.ipc.open_stream(bytes(self.entries.get()[0])).read_pandas()

    def _put(self, known: pd.DataFrame, timer: int | None) -> None:
        """Stores the entries; ``timer`` is the one that is set. It moves to the first entry that expires."""
        at = _first(known)
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if at is None:
            self.entries.clear()
            return
        table, sink = pa.Table.from_pandas(known, _ENTRIES, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.entries.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, known = pd.concat(list(rows))[["owner", "id", "created"]], self._known()
        new = new[new["created"] // 1000 > timerValues.getCurrentWatermarkInMs()]  # else expired when it came
        both = pd.concat([known.assign(_new=False), new.assign(_new=True)], ignore_index=True)
        both = both.sort_values(["created", "_new"], ascending=[True, False], kind="stable")  # of the same time, what is known counts
        last = ~both.duplicated(["owner", "id"], keep="last")
        came, gone = both[last & both["_new"]], both[~last & ~both["_new"]]
        if len(came):
            self._put(both.loc[last, ["owner", "id", "created"]], _first(known))
        yield pd.concat([came.assign(live=True), gone.assign(live=False)])[["owner", "id", "created", "live"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        over = known["created"] // 1000 <= timerValues.getCurrentWatermarkInMs()
        self._put(known[~over], None)  # the timer that fired is gone
        yield known[over].assign(live=False)

    def close(self) -> None:
        pass


def _first(known: pd.DataFrame) -> int | None:
    """The millisecond in which the first entry expires."""
    return int(known["created"].min() // 1000) if len(known) else None


def expiring(rows: DataFrame, minutes: int = 360, shards: int = SHARDS) -> DataFrame:
    """(owner, id, created, live): entries (owner, id, created timestamp) as they come, and again as not live when they expire or a newer one of the same id comes.

    Time is that of the entries: one expires when another is newer by ``minutes`` or more. State holds live entries only.
    """
    src = rows.where("created is not null").select(F.col("owner").cast("string").alias("owner"), F.col("id").cast("string").alias("id"), "created").withWatermark("created", f"{minutes} minutes")
    src = src.select(F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard"), "owner", "id", F.unix_micros("created").alias("created"))
    out = src.groupBy("shard").transformWithStateInPandas(Expiring(), CACHE_OUTPUT, "Append", "EventTime")
    return out.withColumn("created", F.timestamp_micros("created"))


def live(changes: DataFrame) -> DataFrame:
    """(owner, id, created) of entries that a table of changes leaves alive."""
    return changes.groupBy("owner", "id", "created").agg(F.bool_and("live").alias("live")).where("live").drop("live")


def run_all(spark: SparkSession, stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """:func:`.logs.run_all` with RocksDB state."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        return logs.run_all(spark, stream, name, mode, checkpoint)
    finally:
        spark.conf.set(key, old)
