"""Best-fit packing of token sequences into bins of several permitted lengths.

Method. Documents become token sequences, and these pieces of at most the largest length. Pieces are dealt by a hash of
their identity into shards of a bounded expected size; a shard is packed on its own, by the pieces' lengths only. In a
shard, by falling length, each piece goes to the open bin that it leaves fullest; if none holds it, a new bin is opened.
Its size is chosen at the least expected cost per token: the bin's cost (its length plus a fixed overhead) over what it is
likely to hold, the piece and what remains of smaller pieces to fill up with. The shard is also packed with each permitted
length as the only one to open (pieces above it open the next that holds them), and the cheapest packing wins. In the end
every bin is downsized to the least permitted length that holds its contents. Then the tokens of the pieces are joined to
their places; the sequence of a bin is its pieces' tokens by slot (:func:`sequences`).

Tokens are the bytes of the UTF-8 text, the tokens of a byte-level vocabulary, cut between characters; or the token ids
of a published vocabulary, by the path of its ``tokenizers`` JSON file, which Spark reads.

Defined results: null or empty texts have no tokens and no piece; a long text has as many pieces as it needs; rows equal
in id and text are packed as often as they occur (``copy`` numbers them), rows that share an id but not the text are told
apart by ``text_hash``; a null id is an id; equal lengths are ordered by document, text and piece; an empty table gives no
row; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices

#: Permitted sequence lengths.
CAPACITIES = (1024, 2048, 4096, 8192, 16384)
OVERHEAD = 16
#: Pieces that a shard has on average at most.
SHARD_PIECES = 20_000


def _capacity(caps: tuple[int, ...], size: int) -> int:
    return caps[bisect_left(caps, size)]


class _Open:
    """Open bins by room, smallest sufficient first."""

    def __init__(self):
        self.rooms: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, b: int) -> None:
        if room not in self.bins:
            insort(self.rooms, room)
            self.bins[room] = []
        self.bins[room].append(b)

    def take(self, size: int) -> tuple[int, int] | None:
        i = bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        b = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room], self.rooms[i]
        return room, b


def _pack(sizes: list[int], caps: tuple[int, ...], only: int | None, overhead: int) -> tuple[list[int], list[int], int]:
    """Bin of each of the falling ``sizes``, contents of the bins, cost after downsizing."""
    left = sum(sizes)
    bins, held, open_ = [], [], _Open()
    for size in sizes:
        left -= size
        got = open_.take(size)
        if got:
            room, b = got
        else:
            fits = caps[bisect_left(caps, size) :]
            if only is None:
                room = min(fits, key=lambda c: ((c + overhead) / min(c, size + left), -c))
            else:
                room = next((c for c in fits if c >= only), fits[-1])
            b = len(held)
            held.append(0)
        bins.append(b)
        held[b] += size
        if room > size:
            open_.add(room - size, b)
    return bins, held, sum(_capacity(caps, h) + overhead for h in held)


def best_fit(sizes: list[int], caps: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bins of ``sizes`` (falling) and the downsized capacity of every bin, of the cheapest of all packings."""
    caps = tuple(sorted(caps))
    bins, held, _ = min((_pack(sizes, caps, c, overhead) for c in (None, *caps)), key=lambda x: x[2])
    return bins, [_capacity(caps, h) for h in held]


def cuts(data: bytes, most: int) -> list[int]:
    """Where pieces of at most ``most`` bytes of a UTF-8 text begin, and its end; no character is cut (``most`` is 4 at least)."""
    out, n = [0], len(data)
    while out[-1] + most < n:
        at = out[-1] + most
        while data[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return [*out, n] if n else out


class _Tokens:
    """Token sequences of texts: UTF-8 bytes, or ids by the ``tokenizers`` JSON file in a broadcast."""

    def __init__(self, vocabulary=None):
        self.vocabulary, self.made = vocabulary, None

    def __call__(self, texts: list[bytes | None]) -> list:
        if self.vocabulary is None:
            return [t or b"" for t in texts]
        if self.made is None:
            from tokenizers import Tokenizer

            self.made = Tokenizer.from_str(self.vocabulary.value)
            self.made.encode_special_tokens = True
        return [e.ids for e in self.made.encode_batch([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def cuts(self, tokens, most: int) -> list[int]:
        if self.vocabulary is None:
            return cuts(tokens, most)
        return [*range(0, len(tokens), most), len(tokens)]


def _vocabulary(spark, path: str | None):
    if path is None:
        return None
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]  # some MB
    return spark.sparkContext.broadcast(bytes(raw).decode())


def _pieces(src: DataFrame, kind: str, make: _Tokens, most: int, with_tokens: bool) -> DataFrame:
    """Of (doc_id, text_hash, text): a row per text with all cuts, or a row per piece with its tokens."""
    ids = make.vocabulary is not None

    def run(batches):
        made = _Tokens(make.vocabulary)
        for batch in slices(batches, "text"):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            tokens = made(texts)
            at = [made.cuts(t, most) if len(t) else [0] for t in tokens]
            if not with_tokens:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "cuts"])
                continue
            row = pa.array([i for i, a in enumerate(at) for _ in a[1:]], pa.int64())
            parts = [t[x:y] for t, a in zip(tokens, at, strict=True) for x, y in zip(a, a[1:], strict=False)]
            number = [k for a in at for k in range(len(a) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(number, pa.int64()), pa.array(parts, pa.list_(pa.int32()) if ids else pa.binary())], names=["doc_id", "text_hash", "piece", "tokens"]
            )

    out = f"doc_id {kind}, text_hash long, " + (f"piece long, tokens {'array<int>' if ids else 'binary'}" if with_tokens else "cuts array<long>")
    return src.mapInArrow(run, out)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, caps: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """A row per piece: shard, bin, capacity, slot and offset in the bin; id, text_hash, copy, piece, start and end in its tokens; its tokens."""
    caps = tuple(sorted(caps))
    most = caps[-1]
    make = _Tokens(_vocabulary(docs.sparkSession, vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    whole = _pieces(src, kind, make, most, False).where("size(cuts) > 1")
    # Equal rows are counted and numbered, so that each is a text of its own.
    whole = keep(whole.groupBy("doc_id", "text_hash", "cuts").agg(F.count("*").alias("k")))
    known = whole.agg(F.sum(F.col("k") * (F.size("cuts") - 1)).alias("pieces"), F.max("k").alias("k")).first()
    shards = max(1, -(-int(known.pieces or 0) // shard_pieces))
    pieces = whole.selectExpr("doc_id", "text_hash", "cuts", "explode(sequence(1L, k)) as copy").selectExpr("doc_id", "text_hash", "copy", "cuts", "posexplode(slice(cuts, 1, size(cuts) - 1)) as (piece, start)")
    pieces = pieces.selectExpr("doc_id", "text_hash", "copy", "cast(piece as bigint) as piece", "start", "get(cuts, piece + 1) as end")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", "piece"), F.lit(shards)).cast("long"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.assign(size=pdf["end"] - pdf["start"]).sort_values(["size", "doc_id", "text_hash", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
        bins, capacity = best_fit(pdf["size"].tolist(), caps, overhead)
        pdf["bin"] = bins
        pdf["capacity"] = [capacity[b] for b in bins]
        pdf["slot"] = pdf.groupby("bin").cumcount()
        pdf["offset"] = pdf.groupby("bin")["size"].cumsum() - pdf["size"]
        return pd.DataFrame({c: pdf[c] for c in ("shard", "bin", "capacity", "slot", "offset", "doc_id", "text_hash", "copy", "piece", "start", "end")})

    schema = f"shard long, bin long, capacity long, slot long, offset long, doc_id {kind}, text_hash long, copy long, piece long, start long, end long"
    placed = pieces.groupBy("shard").applyInPandas(run, schema)
    if (known.k or 0) > 1:
        src = src.dropDuplicates(["doc_id", "text_hash"])
    said = _pieces(src, kind, make, most, True).withColumnsRenamed({"doc_id": "id2", "text_hash": "hash2", "piece": "piece2"})
    on = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("text_hash") == F.col("hash2")) & (F.col("piece") == F.col("piece2"))
    return placed.join(said, on).drop("id2", "hash2", "piece2")


def sequences(packed: DataFrame) -> DataFrame:
    """(shard, bin, capacity, pieces, tokens) of every bin of :func:`pack`: its pieces and their tokens by slot; at most ``capacity`` tokens."""
    row = F.struct("slot", "offset", "doc_id", "copy", "piece", "start", "end", "tokens")
    out = packed.groupBy("shard", "bin", "capacity").agg(F.array_sort(F.collect_list(row)).alias("p"))
    parts = F.transform("p", lambda x: x["tokens"])
    binary = packed.schema["tokens"].dataType.simpleString() == "binary"
    tokens = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)) if binary else F.flatten(parts)
    return out.select("shard", "bin", "capacity", F.transform("p", lambda x: x.dropFields("tokens")).alias("pieces"), tokens.alias("tokens"))


def op10(spark, docs: DataFrame) -> DataFrame:
    """Every document's pieces in their bins, with their tokens."""
    return pack(docs.select("doc_id", "text"))
