"""Operator 13 against an exhaustive search over edits."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import convrepair as cr

WELL = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        last = BLANK.findall(text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(turns):
    """(cost, audit, repaired) by trying every edit of every turn, and up to two insertions at every place."""
    bad = faults(turns)

    @functools.cache
    def tails(i, said):
        """All (cost, audit, lines) from turn i on, after roles ``said`` (its last two are enough to judge what follows)."""
        found = []
        for k in range(3):
            for ins in range(2**k):
                add = [("user", "assistant")[ins >> j & 1] for j in range(k)]
                initials = said + "".join(r[0] for r in add)
                if not re.fullmatch("(s|(s?(ua)*u?))?", initials):
                    continue
                head = (3 * k, "I" * k, tuple(f"{r}:" for r in add))
                if i == len(turns):
                    if WELL.fullmatch(initials):
                        found.append(head)
                    continue
                role, text = turns[i]
                moves = [(4, "D", None)]
                if bad[i] not in ("blank", "duplicate"):
                    more = 3 if bad[i] == "truncated" else 0
                    moves += [(more, "K", role)] + [(3 + more, "R", r) for r in ("user", "assistant")]
                for cost, letter, r in moves:
                    now = initials if r is None else initials + (r[:1] or "?")
                    if not re.fullmatch("(s|(s?(ua)*u?))?", now):
                        continue
                    rest = tails(i + 1, now)
                    if rest:
                        c, a, lines = rest
                        found.append((head[0] + cost + c, head[1] + letter + a, head[2] + (() if r is None else (f"{r}:{text}",)) + lines))
        return min(found, key=lambda x: x[:2], default=None)

    return tails(0, "")


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "unknown", "tool", "", " "]), st.sampled_from(["", " \n", "Yes.", "No!", "and", "so?", "a. ", "b"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=6))
def test_best_edits_are_those_of_an_exhaustive_search(turns):
    said, lines = cr._summary([(i, r, t) for i, (r, t) in enumerate(turns)])
    cost, audit, want = exhaustive(turns)
    assert (said["cost"], said["audit"], [f"{r}:{t}" for _, r, t in lines]) == (cost, audit, list(want))
    assert said["repaired_sha256"] == hashlib.sha256("\n".join(want).encode()).hexdigest()


def brute(rows) -> dict:
    """The contract's columns from undamaged rows (conv, turn, role, text), by exhaustive search."""
    convs = defaultdict(list)
    sp = lambda x: " " if x is None else x
    for c, n, role, text in rows:
        convs[c]
        k = zlib.crc32(f"{sp(c)}:{sp(n)}".encode()) % 20
        role, text = sp(role), sp(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[c] += [(n, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        bad = faults([x[1:] for x in turns])
        numbers = [x[0] for x in turns if x[0] is not None]
        cost, audit, lines = exhaustive([x[1:] for x in turns])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[c] = (gaps, *(bad.count(f) for f in cr.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df) -> dict:
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_over_the_table_against_exhaustive_search(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert result(cr.op13(spark, df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.fixture(scope="module")
def odd():
    r = random.Random(5)
    rows = []
    for c in [None, *range(60)]:
        for n in range(r.randrange(1, 8)):
            if r.random() < 0.85:
                rows.append((c, n if r.random() < 0.95 or n else None, r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "No", " ", "", None, "What? ", "long " * 500, "Ünï!"])))
    return [x for i, x in enumerate(rows) if (x[0], x[1]) not in {y[:2] for y in rows[:i]}]


@pytest.mark.parametrize("long_turns,long_chars", [(5000, 10**6), (3, 10**6), (1, 10**6), (5000, 100), (0, 0)])
def test_blocks_give_what_whole_conversations_give(spark, odd, long_turns, long_chars):
    df = spark.createDataFrame([(*x, 1) for x in odd], "conv_id long, turn long, role string, text string, cost int").repartition(3)
    bad = cr.damaged(df)
    got = result(cr.summaries(bad, long_turns=long_turns, long_chars=long_chars))
    assert got == brute(odd)
    turns = defaultdict(list)
    for r in sorted(cr.repaired_turns(bad, long_turns=long_turns, long_chars=long_chars).collect(), key=lambda r: r.place):
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in got} == {c: v[-1] for c, v in got.items()}


def test_one_conversation_of_many_turns(spark):
    r = random.Random(3)
    rows = [(7, i // 2, r.choice(["user", "assistant"]), f"{r.choice(['Yes', 'No'])} {i % 400}{r.choice('.,')}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole, cut = (result(cr.summaries(df, long_turns=n)) for n in (5000, 70))
    assert whole == cut and len(whole[7][6]) > 2900


def test_defined_results(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = hashlib.sha256(b"").hexdigest()
    dropped = next(n for n in range(1000) if zlib.crc32(f"1:{n}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, dropped, "user", "Hello.")], schema)
    assert result(cr.op13(spark, df)) == {1: (0, 0, 0, 0, 0, 0, "", empty)}
    assert result(cr.summaries(cr.damaged(df), long_turns=0)) == {1: (0, 0, 0, 0, 0, 0, "", empty)}
    assert not cr.op13(spark, df.where("false")).collect()
    # Repeated rows: the second of each is a repeat.
    twice = spark.createDataFrame([(2, 1, "user", "Hello."), (2, 1, "user", "Hello."), (2, 2, "assistant", "Yes."), (2, 2, "assistant", "Yes.")], schema)
    assert result(cr.summaries(twice))[2][:7] == (0, 0, 2, 0, 2, 8, "KDKD")
    # Ids of another type.
    text = twice.selectExpr("cast(conv_id as string) conv_id", "turn", "role", "text")
    assert result(cr.summaries(text))["2"][6] == "KDKD"
