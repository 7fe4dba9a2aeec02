"""Language identification by hyperdimensional profiles.

Method. Every letter (and the word boundary) has a random vector of +1 and -1 in ``DIM`` dimensions. A trigram's vector
binds (multiplies) the vectors of its letters, permuted (rotated) twice, once and not at all, so that order counts. A
text's vector bundles (adds) the vectors of its trigrams; a language's prototype bundles the unit vectors of its
training texts, less the mean of all prototypes, which is what languages share. A text gets the language whose
prototype has the largest cosine with the text's vector, less the same mean direction.

Every character's vector is a function of its code point, so any script works and all executors agree. Bundling is linear,
so a worker keeps only the vectors of the trigrams of its slice.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was
learned; ties go to the first language by name; texts with a null language, null texts and texts without letters teach
nothing; texts may have any length (their distinct trigrams are bundled in pieces); repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

DIM = 512
#: Trigram vectors that a Python worker remembers (DIM bytes each).
REMEMBERED = 60_000

_SYMBOLS = 1 << 20  # symbol 0 is the word boundary, every other symbol a lower-case letter's code point
_tables: dict[int, np.ndarray] = {}


def _alphabet() -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter, else the code point of its lower case (above 2^20: less 2^20, which no letter has)."""
    if 0 not in _tables:
        t = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                t[c] = ord(ch.lower()[0]) % _SYMBOLS
        _tables[0] = t
    return _tables[0]


def _letter_vectors(symbols_: np.ndarray) -> np.ndarray:
    """The random vectors of symbols, from a hash of each symbol."""
    word = np.arange(DIM // 64, dtype=np.uint64)
    x = symbols_.astype(np.uint64)[:, None] * np.uint64(DIM // 64) + word + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).astype(np.int8) * 2 - 1)[:, :DIM]


def symbols(text: str) -> np.ndarray:
    """Symbols of a text, runs of other characters as one 0, with a 0 at both ends; empty without a letter."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    s = _alphabet()[code].astype(np.int64)
    letter = s > 0
    if not letter.any():
        return s[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    s = s[keep]
    return np.concatenate(([0], s, [0]) if s[-1] else ([0], s)) if s[0] else (np.concatenate((s, [0])) if s[-1] else s)


class Trigrams:
    """Vectors of trigrams, remembered in a table that starts anew when full."""

    def __init__(self):
        self.row = np.empty(0, np.int64)
        self.code = np.empty(0, np.int64)
        self.vec = np.empty((0, DIM), np.int8)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows of sorted distinct codes in ``vec``; new ones are added."""
        at = np.searchsorted(self.code, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.code)
        known[inside] = self.code[at[inside]] == codes[inside]
        new = codes[~known]
        if len(new):
            if len(self.code) + len(new) > max(REMEMBERED, len(codes)):
                self.__init__()
                return self.rows(codes)
            a, b, c = new // (_SYMBOLS * _SYMBOLS), new // _SYMBOLS % _SYMBOLS, new % _SYMBOLS
            used, at3 = np.unique(np.concatenate((a, b, c)), return_inverse=True)
            v = _letter_vectors(used)
            a, b, c = np.split(at3, 3)
            vec = np.roll(v[a], 2, axis=1) * np.roll(v[b], 1, axis=1) * v[c]
            row = np.arange(len(self.vec), len(self.vec) + len(new))
            self.vec = np.concatenate((self.vec, vec))
            code = np.concatenate((self.code, new))
            order = np.argsort(code, kind="stable")
            self.code, self.row = code[order], np.concatenate((self.row, row))[order]
            at = np.searchsorted(self.code, codes)
        return self.row[at]


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts and which of them have a letter."""
    out, has = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    table = _tables.setdefault(2, Trigrams())
    for i, t in enumerate(texts):
        s = symbols(t) if t else ()
        if not len(s):
            continue
        code = (s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:] if len(s) > 2 else s[:1]
        code, count = np.unique(code, return_counts=True)
        row = table.rows(code)
        total = np.zeros(DIM, np.float32)
        for k in range(0, len(row), 4096):
            total += count[k : k + 4096].astype(np.float32) @ table.vec[row[k : k + 4096]].astype(np.float32)
        norm = float(np.sqrt(total @ total))
        has[i] = True
        out[i] = total / norm if norm else total
    return out, has


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """{language: bundle of its texts' unit vectors}: one pass, a vector per language from every task."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            vec, has = text_vectors(batch.column(0).to_pylist())
            lang = np.array(batch.column(1).to_pylist(), object)
            for x in set(lang[has]):
                total[x] = total.get(x, 0) + vec[has & (lang == x)].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "vec"]
        )

    src = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = src.mapInArrow(run, "lang string, vec array<double>")
    summed = parts.selectExpr("lang", "posexplode(vec) as (i, x)").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    return {r.lang: np.array([e.x for e in r.v]) for r in rows}


def classify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text only."""
    names = sorted(prototypes)
    if names:
        p = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names])
        mean = p.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
        mean_unit = mean / max(np.linalg.norm(mean), 1e-12)
        p = p - mean
        p = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        mean_unit = mean_unit.astype(np.float32)
    else:
        p = mean_unit = None
    clash = [c for c in ("lang_pred", "score") if c in docs.columns]
    src = docs.drop(*clash).withColumn("_text", F.col(text_col))
    others = [c for c in src.columns if c != "_text"]

    def run(batches):
        for batch in slices(batches, "_text"):
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if names:
                vec, has = text_vectors(texts)
                vec -= np.outer(vec @ mean_unit, mean_unit)
                vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
                cos = np.clip(vec @ p.T, 0, 1)
                best = cos.argmax(axis=1)
                for i in np.nonzero(has)[0]:
                    pred[i], score[i] = names[best[i]], float(cos[i, best[i]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*others, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*(src.schema[c] for c in others), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return src.mapInArrow(run, schema)


def op3(spark, docs: DataFrame) -> DataFrame:
    """The contract's columns over ``documents``: learns from three folds and from rows without an id, predicts all."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    taught = docs.where(F.coalesce(fold != 2, F.lit(True)) & F.col("lang").isNotNull()).select("text", "lang")
    out = classify(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), learn(taught))
    return out.select("doc_id", "held_out", "lang_pred", "score")
