"""Repair of the turn structure of conversations by a forward Viterbi pass.

Method. A conversation must read ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turn. Four states say
what came last: nothing, s, u or a. Turn by turn every state carries the least (cost, audit string) that leads to it, audits
compared as ASCII. A turn is kept (K, 0), given the role that is due (R, 3) or deleted (D, 4); blank and repeated turns must be
deleted, and a truncated one that stays costs 3 more. Each layer is closed by insertions of empty turns (I, 3), two at most,
as three would come back to a state. Of two audits of the same turns and cost neither begins with the other, so the lesser prefix
stays the lesser, and one best entry a state is enough.

Conversations up to ``LONG_TURNS`` turns and ``LONG_CHARS`` code points are repaired as wholes by the task that has them. A longer
one, which may be a third of the table, is sorted in ranges and cut into blocks. Costs add and audits join, so the pass over a
block is a matrix of four by four entries that does not depend on what came before; the matrices of a
conversation are multiplied in order (some 16 bytes a turn), and every block then applies its own piece of the audit. Repeats
are found by grouping on role and text. Only the hash of the repaired text is sequential by definition: one task reads the repaired
turns of a long conversation in order, and holds none of them.

Defined results: a null role or text is one space; turns are ordered by number, nulls first, then role, then hash of the text, then text;
a role counts by its first character, so ``unknown`` can stand where a user is due, and an empty role can only be replaced; a
row that repeats is a turn that repeats; a null conversation id is a conversation; an empty table gives no row; texts and
conversations may have any length (a result of the contract's form has the audit of a conversation in one value); extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep, slices

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Beyond either, a conversation is cut into blocks, which have no more than that themselves.
LONG_TURNS, LONG_CHARS = 5_000, 8_000_000
#: Long conversations are broadcast up to this number of ids.
BROADCAST_IDS = 1_000_000
BLANKS = " \t\n\x0b\x0c\r"
#: States, and the states from which a turn of that role may follow.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_BEFORE = {SYSTEM: (BEGIN,), USER: (BEGIN, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("blank", "duplicate", "truncated")

#: A layer: for every state the best (cost, audit), or None.
Layer = list[tuple[int, str] | None]


def _better(layer: Layer, state: int, entry: tuple[int, str]) -> bool:
    if layer[state] is None or entry < layer[state]:
        layer[state] = entry
        return True
    return False


def closed(layer: Layer) -> Layer:
    """The layer after the best insertions."""
    fresh = [s for s in range(4) if layer[s]]
    while fresh:
        found = []
        for s in fresh:
            cost, audit = layer[s]
            to = ASSISTANT if s == USER else USER
            if _better(layer, to, (cost + INSERT, audit + "I")):
                found.append(to)
        fresh = found
    return layer


def step(layer: Layer, initial: str, fault: str | None) -> Layer:
    """The closed layer after one turn whose role begins with ``initial``."""
    out: Layer = [entry and (entry[0] + DELETE, entry[1] + "D") for entry in layer]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        own = _STATE.get(initial)
        for to, before in _BEFORE.items():
            cost, letter = (KEEP, "K") if to == own else (REROLE, "R")
            if to == SYSTEM and to != own:
                continue
            for s in before:
                if layer[s]:
                    _better(out, to, (layer[s][0] + cost + more, layer[s][1] + letter))
    return closed(out)


def start() -> Layer:
    return closed([(0, ""), None, None, None])


def best(layer: Layer) -> tuple[int, str, int]:
    """(cost, audit, state) of the best end: nothing at all, or after an assistant."""
    return min((*layer[s], s) for s in (BEGIN, ASSISTANT) if layer[s])


def fault_of(role: str, text: str, seen: set) -> str | None:
    """The first fault of a turn; ``seen`` has the earlier (role, text)."""
    bare = text.strip(BLANKS)
    if not bare:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return None if bare[-1] in ".!?" else "truncated"


def applied(audit: str, turns: Iterable[tuple[str, str]], state: int = BEGIN) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves, from ``state`` on."""
    rest = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            state = _STATE[role[0]]
        else:
            state = ASSISTANT if state == USER else USER
            role = _ROLE[state]
        yield edit, role, text


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _hash(lines: Iterable[tuple[str, str]]) -> str:
    h, first = hashlib.sha256(), True
    for role, text in lines:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return h.hexdigest()


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summary(turns: list[tuple]) -> tuple[dict, list[tuple[str, str, str]]]:
    """The counts, cost, audit and hash of one conversation of turns (number, role, text) in order, and its repaired turns."""
    layer, seen, faults = start(), set(), []
    for _, role, text in turns:
        fault = fault_of(role, text, seen)
        seen.add((role, text))
        faults.append(fault)
        layer = step(layer, role[:1], fault)
    cost, audit, _ = best(layer)
    lines = list(applied(audit, ((r, t) for _, r, t in turns)))
    numbers = {n for n, _, _ in turns if n is not None}
    out = {"gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0}
    out |= {f: faults.count(f) for f in FAULTS}
    out |= {"illegal": sum(_illegal(a[1][:1], b[1][:1]) for a, b in zip(turns, turns[1:])), "cost": cost, "audit": audit}
    return out | {"repaired_sha256": _hash((r, t) for _, r, t in lines)}, lines


def _sorted(turns: DataFrame, *cols: str) -> DataFrame:
    return turns.sortWithinPartitions(*cols, "turn", "role", F.xxhash64("text"), "text")


def _whole(turns: DataFrame, lines: bool) -> DataFrame:
    """Summaries, or the repaired turns, of conversations that a task can hold; a row with ``there`` false only names its conversation."""
    kind = turns.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, place int, edit string, role string, text string" if lines else f"conv {kind}, {_SUMMARY}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def rows_of(conv, held: list[tuple]) -> list[dict]:
        said, repaired = _summary(held)
        if lines:
            return [{"conv": conv, "place": i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(repaired)]
        return [{"conv": conv, **said}]

    def run(batches):
        conv, held, begun, size = None, [], False, 0
        for batch in slices(batches, "text"):
            out = []
            for c, n, role, text, there in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if begun and c != conv:
                    out += rows_of(conv, held)
                    held = []
                conv, begun = c, True
                if there:
                    held.append((n, role, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if begun:
            yield pa.RecordBatch.from_pylist(rows_of(conv, held), schema=arrow)

    return _sorted(turns.select("conv", "turn", "role", "text", "there").repartition("conv"), "conv").mapInArrow(run, schema)


def _blocks(turns: DataFrame, long_turns: int, long_chars: int) -> DataFrame:
    """The turns in their order (part, pos), cut into blocks (part, blk) of one conversation each, with initial and fault but for repeats."""
    kind = {c: turns.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    names = ["conv", "turn", "role", "text", "part", "pos", "blk", "initial", "fault"]

    def run(batches):
        from pyspark import TaskContext

        part, pos, blk, used, chars, conv = TaskContext.get().partitionId(), 0, -1, 0, 0, None
        for batch in slices(batches, "text"):
            cols: list[list] = [[], [], [], [], []]
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if blk < 0 or c != conv or used >= long_turns or chars > long_chars:
                    blk, used, chars, conv = blk + 1, 0, 0, c
                for col, v in zip(cols, (part, pos, blk, role[:1], fault_of(role, text, set())), strict=True):
                    col.append(v)
                pos, used, chars = pos + 1, used + 1, chars + len(text)
            types = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    h = F.xxhash64("text")
    ranged = _sorted(turns.select("conv", "turn", "role", "text").repartitionByRange("conv", "turn", "role", h), "conv")
    return ranged.mapInArrow(run, f"conv {kind['conv']}, turn {kind['turn']}, role string, text string, part int, pos long, blk int, initial string, fault string")


def _matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: its counts, its first and last initial, and (from, to, cost, audit) of all ways through it."""
    pdf = pdf.sort_values("pos")
    initials, faults = pdf["initial"].tolist(), pdf["fault"].tolist()
    ways = []
    for s in range(4):
        layer: Layer = [None] * 4
        layer[s] = (0, "")
        for i, f in zip(initials, faults, strict=True):
            layer = step(layer, i, f)
        ways += [{"from": s, "to": t, "cost": e[0], "audit": e[1]} for t, e in enumerate(layer) if e]
    said = {f: faults.count(f) for f in FAULTS} | {"illegal": sum(map(_illegal, initials, initials[1:])), "opens": initials[0], "ends": initials[-1], "ways": [ways]}
    return pd.DataFrame({"conv": pdf["conv"].iloc[:1].tolist(), "part": pdf["part"].iloc[0], "blk": pdf["blk"].iloc[0], **said})


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """The matrices of a conversation multiplied: a row for the whole (blk null) and one for each block, with its state before and its piece."""
    pdf = pdf.sort_values(["part", "blk"])
    layer = start()
    lead, came = [e and e[1] for e in layer], []
    for ways in pdf["ways"]:
        new: Layer = [None] * 4
        back: list = [None] * 4
        for w in ways:
            if (e := layer[w["from"]]) and _better(new, w["to"], (e[0] + w["cost"], e[1] + w["audit"])):
                back[w["to"]] = (w["from"], w["audit"])
        came.append(back)
        layer = new
    cost, audit, state = best(layer)
    pieces = []
    for back in reversed(came):
        state, piece = back[state]
        pieces.append((state, piece))
    pieces.reverse()
    if lead[pieces[0][0]]:  # what was inserted before the first turn
        pieces[0] = (BEGIN, lead[pieces[0][0]] + pieces[0][1])
    opens, ends = pdf["opens"].tolist(), pdf["ends"].tolist()
    illegal = int(pdf["illegal"].sum()) + sum(map(_illegal, ends, opens[1:]))
    n = len(pdf)
    return pd.DataFrame(
        {
            "conv": pdf["conv"].iloc[:1].tolist() * (n + 1),
            "part": [-1, *pdf["part"]],
            "blk": [-1, *pdf["blk"]],
            "state": [-1, *(s for s, _ in pieces)],
            "audit": [audit, *(p for _, p in pieces)],
            "cost": [cost] * (n + 1),
            "illegal": [illegal] * (n + 1),
            **{f: [int(pdf[f].sum())] * (n + 1) for f in FAULTS},
        }
    )


def _apply_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
    """The repaired turns of one block."""
    left = left.sort_by("pos")
    (piece,) = right.to_pylist()
    done = list(applied(piece["audit"], zip(left["role"].to_pylist(), left["text"].to_pylist(), strict=True), piece["state"]))
    n = len(done)
    conv = pa.chunked_array([left["conv"].combine_chunks().take(pa.array([0] * n, pa.int64()))], left["conv"].type)
    edits, roles, texts = ([d[i] for d in done] for i in range(3))
    return pa.table(
        {"conv": conv, "part": pa.array([piece["part"]] * n, pa.int32()), "blk": pa.array([piece["blk"]] * n, pa.int32()), "at": pa.array(range(n), pa.int32()),
         "edit": pa.array(edits, pa.string()), "role": pa.array(roles, pa.string()), "text": pa.array(texts, pa.string())}
    )


def _hashes(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired turns in the order (part, blk, at), read once in order."""
    kind = lines.schema["conv"].dataType.simpleString()

    def run(batches):
        conv, h = None, None
        for batch in slices(batches, "text"):
            done = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if h is None or c != conv:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    h.update(f"\n{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], batch.column(0).type), pa.array([x for _, x in done])], names=["conv", "repaired_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], batch.column(0).type), pa.array([h.hexdigest()])], names=["conv", "repaired_sha256"])

    ordered = lines.repartition("conv").sortWithinPartitions("conv", "part", "blk", "at")
    return ordered.select("conv", "role", "text").mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def _long(turns: DataFrame, tmp: Scratch, long_turns: int, long_chars: int) -> tuple[DataFrame, DataFrame]:
    """Summaries without gaps and hash, and the repaired turns (conv, part, blk, at, edit, role, text), of conversations in blocks."""
    kind = turns.schema["conv"].dataType.simpleString()
    rows = tmp.write(_blocks(turns.where("there"), long_turns, long_chars), "blocks")
    first = rows.where("fault is null or fault <> 'blank'").groupBy("conv", "role", "text").agg(F.min(F.struct("part", "pos")).alias("at")).select("at.part", "at.pos", F.lit(True).alias("first"))
    facts = rows.select("conv", "part", "pos", "blk", "initial", "fault").join(first, ["part", "pos"], "left")
    facts = facts.withColumn("fault", F.when((F.col("fault") == "blank") | F.col("first").isNotNull(), F.col("fault")).otherwise("duplicate")).drop("first")
    counts = "blank long, duplicate long, truncated long, illegal long"
    ways = "array<struct<`from`: int, `to`: int, cost: bigint, audit: string>>"
    made = facts.groupBy("part", "blk").applyInPandas(_matrix, f"conv {kind}, part int, blk int, {counts}, opens string, ends string, ways {ways}")
    whole = tmp.write(made.groupBy("conv").applyInPandas(_product, f"conv {kind}, part int, blk int, state int, audit string, cost long, illegal long, blank long, duplicate long, truncated long"), "products")
    pieces = whole.where("blk >= 0").select("part", "blk", "state", "audit").groupBy("part", "blk")
    lines = rows.select("conv", "part", "blk", "pos", "role", "text").groupBy("part", "blk").cogroup(pieces)
    lines = lines.applyInArrow(_apply_blocks, f"conv {kind}, part int, blk int, at int, edit string, role string, text string")
    return whole.where("blk < 0").drop("part", "blk", "state"), lines


def _split(turns: DataFrame, long_turns: int, long_chars: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The turns of conversations that a task can hold, those of the others, and the ids of the others; None if there are none."""
    size = turns.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    long = keep(size.where(f"n > {long_turns} or chars > {long_chars}").select(F.col("conv").alias("id")))
    n = long.count()
    if not n:
        return turns, turns.where("false"), None
    ids, on = (F.broadcast(long) if n <= BROADCAST_IDS else long), F.col("conv").eqNullSafe(F.col("id"))
    return turns.join(ids, on, "left_anti"), turns.join(ids, on, "left_semi"), long


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    there = F.col("there") if "there" in conversations.columns else F.lit(True)
    return conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), there.alias("there"))


def summaries(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long_turns: int = LONG_TURNS, long_chars: int = LONG_CHARS
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows whose column ``there``, if there is one, is false only name a conversation.
    """
    small, large, long = _split(_turns(conversations, conv, turn, role, text), long_turns, long_chars)
    out = _whole(small, lines=False)
    if long is None:
        return out.withColumnRenamed("conv", conv)
    with Scratch(conversations.sparkSession, "conversations") as tmp:
        said, lines = _long(large, tmp, long_turns, long_chars)
        hashes = _hashes(lines)
        gaps = large.where("there and turn is not null").groupBy("conv", "turn").count().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
        both = long
        for part in (said, hashes, gaps):
            part = part.withColumnRenamed("conv", "key")
            both = both.join(part, F.col("id").eqNullSafe(F.col("key")), "left").drop("key")
        zero = {f: 0 for f in ("gaps", *FAULTS, "illegal", "cost")} | {"audit": "", "repaired_sha256": _hash([])}
        both = both.fillna(zero).select(F.col("id").alias("conv"), "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256")
        return keep(out.unionByName(both)).withColumnRenamed("conv", conv)


def repaired_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long_turns: int = LONG_TURNS, long_chars: int = LONG_CHARS
) -> DataFrame:
    """(conv, place, edit, role, text): the repaired turns; ``place`` counts from 0 in a conversation and grows, with gaps in long ones."""
    small, large, long = _split(_turns(conversations, conv, turn, role, text), long_turns, long_chars)
    out = _whole(small, lines=True).withColumn("place", F.col("place").cast("long"))
    if long is None:
        return out.withColumnRenamed("conv", conv)
    with Scratch(conversations.sparkSession, "conversations") as tmp:
        _, lines = _long(large, tmp, long_turns, long_chars)
        # A block has at most twice its turns and two more.
        place = (F.col("part").cast("long") * (1 << 20) + F.col("blk")) * (1 << 24) + F.col("at")
        return keep(out.unionByName(lines.select("conv", place.alias("place"), "edit", "role", "text"))).withColumnRenamed("conv", conv)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``; dropped rows stay, with ``there`` false and no text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(hit <= 1, "").when(hit == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(hit == 4, "user").otherwise(blank("role"))
    out = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (hit != 0).alias("there"), F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"))
    return out.select("conv_id", "turn", "role", "text", "there", F.explode("times")).drop("col")


def op13(spark, conversations: DataFrame) -> DataFrame:
    """The contract's columns over ``conversations``."""
    return summaries(damaged(conversations.select("conv_id", "turn", "role", "text")))
