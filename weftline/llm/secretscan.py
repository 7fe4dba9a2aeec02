"""Secret scan by assignment-aware lexing.

Method. Source and configuration syntax (``name = literal``, ``name: literal``, ``"name": "literal"``,
``export NAME=literal``, ``name := literal``, ``name => literal``, ``<name>literal</name>``) is lexed into name-literal
pairs wherever an assignment sign stands; the name of ``config["token"] = literal`` is the quoted subscript. A call is no literal. A right-hand side may join quoted literals with ``+`` or ``.`` and may name
an earlier constant of the same text, whose literals then count for the new name too; a name means what it was given last.
Of strings over several lines (triple quotes, indented blocks after ``name: |``) every line is a literal. A literal is scored by the target
name (sensitive words such as password, secret, token, key) and by its own shape (length, character classes, entropy);
those of ``SCORE`` or more are secrets. A literal with spaces is one if it looks like a passphrase and is given to a password. Patterns with a form of their own (assign, access, hex) are always reported.

Defined results: a null or empty text has no spans; offsets count code points, ends are exclusive; of equal spans
of one kind one is kept; texts, names and literals may have any length (work is linear in the text, but for constants of several
lines that are nested in each other and all used again); an empty table gives no
row; repeated rows give equal rows; an id may be of any type or null; extra columns are ignored (kept by :func:`redacted`).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "literal")
SCORE = 1.0
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_HEX_HINT = re.compile(r"[0-9a-f]*[0-9][0-9a-f]*")
# Weights of words in a target name.
NAMES = {
    "password": 0.9, "passwd": 0.9, "pwd": 0.9, "passphrase": 0.9, "secret": 0.9, "token": 0.8, "apikey": 0.9, "credential": 0.8, "credentials": 0.8,
    "auth": 0.5, "authorization": 0.6, "bearer": 0.7, "private": 0.4, "key": 0.5, "api": 0.3, "access": 0.3, "session": 0.3, "signature": 0.4, "salt": 0.4, "cookie": 0.4, "pass": 0.6,
    "id": -0.2, "hash": -0.3, "public": -0.5, "version": -0.6, "url": -0.4, "path": -0.4, "name": -0.3, "file": -0.3,
}
# Words that tell of a sentence about a password.
_SPOKEN = frozenset("a an the your you my our is are was be to of or and for in on at with enter type use please must should not no this that it password passwords passphrase reset new old".split())
_PHRASE_WORD = re.compile("[a-z0-9][a-z0-9'-]*")
LEAST = 8
_SIGN = re.compile(r":=|=>|[:=]")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_NAME_START = re.compile(r"\b[A-Za-z_]")
_QUOTED = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""")
_JOIN = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'`A-Za-z_])")
_BARE = re.compile(r"[ \t]*([^\s\"'`,;<>(){}\[\]|]+)")
_INNER = re.compile(r"[ \t]*([^\s\"'`,;<>(){}\[\]|&=:]+={0,2})")
_NAME = re.compile(r"[ \t]*([A-Za-z_][A-Za-z0-9_]*+)(?!\()")
_LONG = re.compile(r"""[ \t]*[rbfRBF]{0,2}(\"{3}|'{3})""")
_BLOCK = re.compile(r"[ \t]*[|>][0-9+-]*[ \t]*(?=\n)")
_LINE = re.compile(r"[^\n]+")
_TAG = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\n]{8,}+)</\1>")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)^(?:x{4,}|\*{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|change_?me|example|placeholder|none|null|true|false|undefined|your[_-].*)$")


def name_score(name: str) -> float:
    """Sum of the weights of the words of a name."""
    words = {w.lower() for w in _PARTS.findall(name)}
    return max(sum(NAMES.get(w, 0.0) for w in words), NAMES.get(name.lower().replace("_", "").replace("-", ""), 0.0))


def literal_score(value: str) -> float:
    """From -1 (not a secret) to 0.6, by length, character classes and entropy per character."""
    if len(value) < LEAST or _PLACEHOLDER.match(value) or "://" in value[:12] or " " in value:
        return -1.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    classes = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value))))
    return min(0.6, 0.1 * (classes - 1) + 0.1 * max(0.0, entropy - 2.0) + (0.1 if n >= 16 else 0.0))


def phrase_score(name: str, value: str) -> float:
    """0.3 for a passphrase: several plain words given to a password; else -1."""
    words = value.split(" ")
    named = {w.lower() for w in _PARTS.findall(name)}
    if not 3 <= len(words) <= 24 or not all(_PHRASE_WORD.fullmatch(w) for w in words) or named & _SPOKEN.intersection(words):
        return -1.0
    if "passphrase" in named or (named & {"password", "passwd", "pwd"} and len(words) > 3 and not _SPOKEN.intersection(words)):
        return 0.3
    return -1.0


def _left(text: str, at: int) -> str | None:
    """The quoted or bare name, or the quoted subscript, that ends before the sign at ``at``; no character is read for two signs."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if not end:
        return None
    if text[end - 1] == "]":
        if end < 3 or text[end - 2] not in "\"'":
            return None
        end -= 1
    k = end - 1
    if text[k] in "\"'":
        k -= 1
        while k >= 0 and text[k] not in "\"'\n":
            k -= 1
        return text[k + 1 : end - 1] or None if k >= 0 and text[k] != "\n" else None
    while k >= 0 and text[k] in _NAME_CHARS:
        k -= 1
    start = _NAME_START.search(text, k + 1, end)
    return text[start.start() : end] if start else None


def _indent(text: str, at: int) -> int:
    """Blanks before the first other character of the line that ends at ``at`` or goes on there."""
    start = text.rfind("\n", 0, at) + 1
    end = start
    while end < at and text[end] in " -":  # a list item indents as its dash
        end += 1
    return end - start


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the lines between, without blanks around them."""
    out = []
    for m in _LINE.finditer(text, start, end):
        line = m[0].strip()
        if line:
            s = m.start() + len(m[0]) - len(m[0].lstrip())
            out.append((s, s + len(line)))
    return out


class _Indents:
    """Ends of indented blocks; every line is read once, and knows the next one that is indented less."""

    def __init__(self, text: str):
        self.starts, self.indents = [], []
        at = 0
        for line in text.split("\n"):
            if line.strip():
                self.starts.append(at)
                self.indents.append(len(line) - len(line.lstrip(" ")))
            at += len(line) + 1
        self.length, self.less, open_ = len(text), [len(self.starts)] * len(self.starts), []
        for i, n in enumerate(self.indents):
            while open_ and self.indents[open_[-1]] > n:
                self.less[open_.pop()] = i
            open_.append(i)

    def end(self, at: int, least: int) -> int:
        """The end of the lines from ``at`` on that are indented by more than ``least`` blanks, or empty."""
        i = bisect.bisect_left(self.starts, at)
        while i < len(self.starts) and self.indents[i] > least:
            i = self.less[i]
        return self.starts[i] if i < len(self.starts) else self.length


class _Value:
    """The literals of a right-hand side, the lines of a block of text and the constants in it; ``best`` is the highest score of a name that has them."""

    __slots__ = ("best", "block", "parts", "spans", "text")

    def __init__(self, text: str):
        self.best, self.block, self.spans, self.parts, self.text = 0.0, None, [], [], text

    def rise(self, score: float):
        """The literals for which ``score`` is the highest so far."""
        todo = [self]
        while todo:
            v = todo.pop()
            if score > v.best:
                v.best = score
                yield from v.spans
                if v.block:
                    yield from _lines(self.text, *v.block)
                todo += v.parts


def _term(text: str, at: int, constants: dict[str, _Value], value: _Value) -> int:
    """Adds the quoted literal or the constant at ``at`` to ``value``; where it ends, or -1."""
    if q := _QUOTED.match(text, at):
        value.spans.append((q.start(q.lastindex), q.end(q.lastindex)))
        return q.end()
    if (ref := _NAME.match(text, at)) and ref[1] in constants:
        value.parts.append(constants[ref[1]])
        return ref.end()
    return -1


def pairs(text: str):
    """(name, start, end) of literals with constants propagated; only for names of a score above 0 and above earlier ones of the literal."""
    constants: dict[str, _Value] = {}
    unclosed: dict[str, int] = {}  # long quotes that nothing closes from here on
    covered = 0  # end of the last bare literal; one that begins inside it ends at the next sign
    indents, outer = None, []  # of the blocks around a sign: their ends, and the scores of their names
    for sign in _SIGN.finditer(text):
        name, pos, value = _left(text, sign.start()), sign.end(), _Value(text)
        if not name or text.startswith("//", pos):
            continue
        if text.startswith("=", pos):  # a comparison
            continue
        long = _LONG.match(text, pos)
        if long and unclosed.get(long[1], len(text)) > long.end():
            end = text.find(long[1], long.end())
            if end < 0:
                unclosed[long[1]] = long.end()
            else:
                value.spans = _lines(text, long.end(), end)
        elif sign[0] == ":" and (opened := _BLOCK.match(text, pos)):
            indents = indents or _Indents(text)
            begin = opened.end() + 1
            end, score = indents.end(begin, _indent(text, sign.start())), name_score(name)
            while outer and outer[-1][0] <= sign.start():
                outer.pop()
            if end > begin:
                value.block = (begin, end)
                if outer and outer[-1][0] >= end and outer[-1][1] >= score:  # a block around this one gave its lines already
                    value.best = score
                outer.append((end, max(score, outer[-1][1] if outer else 0.0)))
        if not value.spans and not value.block:
            at = _term(text, pos, constants, value)
            if at < 0 and (bare := (_INNER if pos < covered else _BARE).match(text, pos)):
                if text.startswith("(", bare.end(1)):  # a call
                    continue
                stop = bare.end(1)
                covered = max(covered, stop)
                while stop > bare.start(1) and text[stop - 1] in ".,;:!?":
                    stop -= 1
                value.spans.append((bare.start(1), stop))
            while at >= 0 and (more := _JOIN.match(text, at)):
                at = _term(text, more.end(), constants, value)
        if value.spans or value.parts or value.block:
            if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                constants[name] = value
            for s, e in value.rise(name_score(name)):
                yield name, s, e
    for m in _TAG.finditer(text) if "</" in text else ():
        yield m[1], m.start(2), m.end(2)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start, then kind as listed, then end."""
    if not text:
        return []
    found = {("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12} if ":" in text or "=" in text else set()
    if "AKIA" in text:
        found |= {("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18}
    found |= {("hex", m.start(), m.end()) for m in HEX.finditer(text)}
    for name, s, e in pairs(text) if ":" in text or "=" in text or "</" in text else ():
        n = name_score(name)
        if n > 0 and n + max(literal_score(text[s:e]), phrase_score(name, text[s:e])) >= SCORE:
            found.add(("literal", s, e))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, spans: array<struct<kind, start, end>>) of every row."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text"):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc", "spans"])

    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind string, start bigint, end bigint>>")


def redacted(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced; all other columns as they are, lengths counted anew."""

    def run(batches):
        for batch in slices(batches, text_col):
            i = batch.schema.get_field_index(text_col)
            texts = [redact(t, found) if (found := scan(t)) else t for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i).name, pa.array(texts, batch.column(i).type))

    out = docs.mapInArrow(run, docs.schema)
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out


def op4(spark, docs: DataFrame) -> DataFrame:
    """The contract's columns of the scan over ``documents``."""

    def run(batches):
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names[1:]]
            for t in batch.column(1).to_pylist():
                spans = scan(t)
                for i, k in enumerate(KINDS[:3]):
                    out[i].append(sum(s[0] == k for s in spans))
                said = [f"{k}:{s}:{e}" for k, s, e in spans]
                base = ",".join(x for x, s in zip(said, spans, strict=True) if s[0] != "literal")
                out[3].append(hashlib.sha256(base.encode()).hexdigest())
                out[4].append(",".join(said))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
