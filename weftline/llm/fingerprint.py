"""Document fingerprints: a canonical exact digest.

Method. A text is folded: compatibility normalisation and case folding (Unicode's compatibility caseless match, composed
at the end), then every run of white space to one space, none at the ends. Its fingerprint is the 128-bit xxh3 of the
folded UTF-8 bytes in hexadecimal. Rows with equal digests form a bucket, and inside a bucket the bytes themselves are compared:
rows of a bucket are grouped by (digest, bytes), combined in the tasks before the shuffle, so that copies move once a task. A
bucket with one group is settled. Should one ever hold several, the second and later ones in the order of their bytes get
``-1``, ``-2`` and so on. So two rows of a table have equal fingerprints exactly if their folded texts are equal. The likeness of
two fingerprints is 1 if they are equal, else 0: this is an exact digest, not a sketch.

Only bytes of rows whose digest occurs again are moved. A bitmap of at most 2^27 bits, added up by Spark, tells the workers which
these are; what it lets pass needlessly is compared in vain, no more.

Defined results: null reads as the empty text, whose fingerprint is that of no bytes; blank texts have it, too; texts may have any
length; repeated rows have equal fingerprints; an empty table gives no row; extra columns are kept, but for ``fingerprint``, which is
replaced. For the edited texts, rows are in the order of their ids, nulls first, rows of one id in the order of the hash of
their text; a single row is its own next.
"""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, keep, slices

BITS = 128
#: Bits of the bitmap for each digest that occurs again, and bits at most as a power of two.
BITMAP_SPARE, BITMAP_MOST = 16, 27
#: Digests and keys are broadcast up to this number (some 100 bytes each); beyond it they are shuffled.
BROADCAST_KEYS = 1_000_000


def canonical(text: str) -> bytes:
    """The folded text in UTF-8."""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFD", text).casefold()
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", folded).casefold())
    return " ".join(folded.split()).encode()


def digest(folded: bytes, bits: int = BITS) -> bytes:
    """The digest of folded bytes, of all its bits or of the last ``bits``."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(folded)
    return (h if bits >= 128 else h & ((1 << bits) - 1)).to_bytes(16, "big")


def _slot(d: bytes, size: int) -> int:
    return int.from_bytes(d[8:], "big") & (size - 1)


def _bitmap(again: DataFrame) -> np.ndarray:
    """Bits of the digests (digest) of a table, as bytes; of 2^27 bits at most, whatever the number of rows."""
    n = again.count()
    bits = min(BITMAP_MOST, max(10, (n * BITMAP_SPARE).bit_length()))
    at = F.conv(F.substring(F.hex("digest"), 25, 8), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)
    words = again.select(at.alias("at")).selectExpr("at div 8 as w", "shiftleft(1, cast(at % 8 as int)) as b")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r.w] = r.b
    return out


def _folded(docs: DataFrame, cols: list[str], text_col: str, bits: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """``cols`` of ``docs`` with the digest; with a bitmap, rows in it only, and their folded bytes."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    shared = None if bitmap is None else docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in slices(batches, "_text"):
            texts = [canonical(t or "") for t in batch.column(len(cols)).to_pylist()]
            found = [digest(t, bits) for t in texts]
            if shared is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*cols, "digest"])
                continue
            b = shared.value
            hit = [i for i, d in enumerate(found) if b[(s := _slot(d, len(b) << 3)) >> 3] >> (s & 7) & 1]
            rest = batch.take(pa.array(hit, pa.int64())).columns[:-1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([found[i] for i in hit], pa.binary()), pa.array([texts[i] for i in hit], pa.binary())], names=[*cols, "digest", "bytes"])

    made = [StructField("digest", BinaryType())] + ([StructField("bytes", BinaryType())] if shared else [])
    src = docs.select(*(F.col(f"`{c}`") for c in cols), F.col(f"`{text_col}`").alias("_text"))
    return src.mapInArrow(run, StructType([*(src.schema[c] for c in cols), *made]))


def _of(ids: DataFrame, table: DataFrame, on) -> DataFrame:
    """Rows of ``table`` that ``ids`` has, sent to all executors if they are few."""
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, on, "left_semi")


def clashes(digests: DataFrame, texts_of: Callable[[DataFrame, np.ndarray], DataFrame], tmp: Scratch) -> DataFrame | None:
    """(digest, bytes, nth) of the buckets whose rows are not all equal; None if there is none.

    ``digests`` has a row (digest) for each text; ``texts_of`` gives (digest, bytes) of all texts of the digests that it is told, and perhaps others.
    """
    again = tmp.write(digests.groupBy("digest").count().where("count > 1").select("digest"), "again")
    if again.isEmpty():
        return None
    seen = lambda t: texts_of(t, _bitmap(t)).groupBy("digest", "bytes").count()
    several = tmp.write(seen(again).groupBy("digest").count().where("count > 1").select("digest"), "several")
    if several.isEmpty():
        return None
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("bytes")) - 1
    return tmp.write(_of(several, seen(several), "digest").select("digest", "bytes", nth.alias("nth")), "clashes")


def _name(digest_col: str, nth_col: str | None = None):
    name = F.lower(F.hex(digest_col))
    return name if nth_col is None else F.concat(name, F.when(F.col(nth_col) > 0, F.concat(F.lit("-"), F.col(nth_col).cast("string"))).otherwise(""))


def fingerprinted(docs: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with a column ``fingerprint``."""
    cols = [c for c in docs.columns if c != "fingerprint"]
    schema = docs.select(*cols).schema
    row = docs.select(F.struct(*cols).alias("row"), F.col(text_col).alias("t"))
    with Scratch(docs.sparkSession, "fingerprint") as tmp:
        digests = tmp.write(_folded(row, [], "t", bits), "digests")
        clash = clashes(digests, lambda _, bitmap: _folded(row, [], "t", bits, bitmap), tmp)
        if clash is None:
            return _folded(row, ["row"], "t", bits).select("row.*", _name("digest").alias("fingerprint"))
        clash = keep(clash)
    full = _folded(row, ["row"], "t", bits, np.full(1, 255, np.uint8))
    return full.join(clash, ["digest", "bytes"], "left").select(*(F.col("row")[c].alias(c) for c in schema.names), _name("digest", "nth").alias("fingerprint"))


_KEY = "struct<id: {id}, h: bigint>"
_ROW = "key {key}, n_chars long, edited_sha256 string, digest binary, edited_digest binary, same boolean, next {key}, next_digest binary"


def _edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edited_pairs(docs: DataFrame, id_col: str, text_col: str, bits: int, tmp: Scratch) -> DataFrame:
    """For every row its key (id, hash of the text), digest, the digest and SHA-256 of its edited text, and the next row's key and digest.

    Rows are sorted in ranges of (id, hash); a task holds a row and the next one. The last row of a range meets the first
    of the next in a join of as many rows as there are ranges.
    """
    key = _KEY.format(id=docs.schema[id_col].dataType.simpleString())
    row = _ROW.format(key=key)
    text = F.coalesce(text_col, F.lit(""))
    src = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))
    ranged = src.repartitionByRange("key.id", "key.h").sortWithinPartitions("key.id", "key.h", "text")

    def one(key, text, folded, dig, n_key, n_text, n_dig):
        """The columns of a row that knows its next one."""
        edited = _edit(text, n_text)
        changed = canonical(edited)
        return {"key": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "digest": dig, "edited_digest": digest(changed, bits), "same": changed == folded, "next": n_key, "next_digest": n_dig}

    def run(batches):
        from pyspark import TaskContext

        part, before, begun = TaskContext.get().partitionId(), None, False
        for batch in slices(batches, "text"):
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = canonical(t)
                dig = digest(folded, bits)
                if before:
                    out.append({"part": part, "first": None, "last": None, "row": one(*before, k, t, dig)})
                if not begun:
                    begun = True
                    out.append({"part": part, "first": {"key": k, "text": t, "digest": dig}, "last": None, "row": None})
                before = (k, t, folded, dig)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if before:
            k, t, _, dig = before
            yield pa.RecordBatch.from_pylist([{"part": part, "first": None, "last": {"key": k, "text": t, "digest": dig}, "row": None}], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    edge = f"struct<key: {key}, text: string, digest: binary>"
    schema = _parse_datatype_string(f"part int, first {edge}, last {edge}, row struct<{row}>")
    arrow = to_arrow_schema(schema)
    found = tmp.write(ranged.mapInArrow(run, schema), "pairs")
    # The border rows of the ranges; their numbers are all that the driver sees.
    parts = sorted(r.part for r in found.where("first is not null").select("part").toLocalIterator())
    after = docs.sparkSession.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, following int")
    last = found.where("last is not null").select("part", "last").join(after, "part").drop("part")
    both = last.join(found.where("first is not null").select(F.col("part").alias("following"), "first"), "following").select("last", "first")
    closed_schema = _parse_datatype_string(row)
    closed_arrow = to_arrow_schema(closed_schema)

    def close(batches):
        for batch in batches:
            ends = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([one(a["key"], a["text"], canonical(a["text"]), a["digest"], b["key"], b["text"], b["digest"]) for a, b in ends], schema=closed_arrow)

    return found.where("row is not null").select("row.*").unionByName(both.mapInArrow(close, closed_schema))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) of every row."""
    with Scratch(docs.sparkSession, "fingerprint") as tmp:
        rows = tmp.write(edited_pairs(docs, id_col, text_col, bits, tmp), "rows")
        tmp.drop("pairs")
        text = F.coalesce(text_col, F.lit(""))
        keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))

        def edited(told: DataFrame, bitmap: np.ndarray, cols: list[str]) -> DataFrame:
            """Folded edited texts of the digests ``told``, but for those that equal their own row's."""
            want = tmp.write(_of(told.withColumnRenamed("digest", "edited_digest"), rows.where("not same"), "edited_digest").select("key", "next").distinct(), f"want-{uuid.uuid4().hex}")
            texts = _of(want.select(F.explode(F.array("key", "next")).alias("key")).distinct(), keyed, "key").dropDuplicates(["key"])
            made = want.join(texts, "key").join(texts.selectExpr("key as next", "text as following"), "next")
            made = made.selectExpr("key", "next", "concat(substr(text, 1, length(text) - length(text) div 4), substr(following, 1, length(text) div 4)) as text")
            return _folded(made, cols, "text", bits, bitmap)

        def texts_of(told: DataFrame, bitmap: np.ndarray) -> DataFrame:
            return _folded(keyed, [], "text", bits, bitmap).unionByName(edited(told, bitmap, []))

        digests = rows.select("digest").unionByName(rows.where("not same").select(F.col("edited_digest").alias("digest")))
        clash = clashes(digests, texts_of, tmp)
        if clash is None:
            return keep(rows.select("key.id", "n_chars", "edited_sha256", _name("digest").alias("fingerprint"), _name("edited_digest").alias("edited_fingerprint"), _name("next_digest").alias("next_fingerprint")))
        told = clash.select("digest").distinct()
        bitmap = _bitmap(told)
        own = tmp.write(_folded(keyed, ["key"], "text", bits, bitmap).join(clash, ["digest", "bytes"]).select("key", "nth").distinct(), "own")
        other = tmp.write(edited(told, bitmap, ["key", "next"]).join(clash, ["digest", "bytes"]).select("key", "next", F.col("nth").alias("edited_nth")).distinct(), "other")
        out = rows.join(own, "key", "left").join(own.selectExpr("key as next", "nth as next_nth"), "next", "left").join(other, ["key", "next"], "left")
        out = out.withColumn("edited_nth", F.when(F.col("same"), F.col("nth")).otherwise(F.col("edited_nth")))
        return keep(
            out.select(
                "key.id", "n_chars", "edited_sha256", _name("digest", "nth").alias("fingerprint"), _name("edited_digest", "edited_nth").alias("edited_fingerprint"), _name("next_digest", "next_nth").alias("next_fingerprint")
            )
        )


def op12(spark, docs: DataFrame) -> DataFrame:
    """The contract's columns over ``documents``."""
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    rows = edited_fingerprints(docs)
    return rows.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
