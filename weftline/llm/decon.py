"""Benchmark decontamination by template canonicalisation.

Method. Texts become sequences of lower-cased words without punctuation in which numbers, names (capitalised words
inside a sentence) and units after a number are typed placeholders. Windows of ``WINDOW`` template tokens of the
benchmark are hash-joined with those of the documents, so a question asked anew with other numbers or names still
matches. The matched windows of a document and an item are grouped by alignment (position in the document less position
in the item): each alignment alone, the alignments within ``DRIFT`` tokens of each other (words put in or left out), and
all together. In a group one value of the item must stand for one value of the document and the other way round, as a
changed parameter changes everywhere. A document holds an item if some group has ``SHARE`` of the item's windows and
consistent values; ``matched`` is the largest such group, and ``exact`` says that one has the item's own values.

A window that many items share (a common stem) is matched for an item only in documents that have another of its windows, unless such
windows alone can reach ``SHARE``; nothing is lost by that. Only windows that the benchmark has leave the document pass; a fixed bitmap and a sorted array of the benchmark's hashes
decide that in the workers. The array is sent to them up to ``BROADCAST_WINDOWS``; beyond it only the bitmap is.

Defined results: null and empty texts and items match nothing; an item shorter than the window is one window of its
whole length, if it has at least ``SHORTEST`` tokens; texts may have any length; repeated rows give one pair of ids; of rows that share an id
the windows count together; of equal matches nothing is chosen, all items are told; rows and items without an
id match nothing; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW, SHORTEST, SHARE = 8, 5, 0.5
#: Tokens put in or left out within one occurrence of an item.
DRIFT = 8
#: Items that share a window of template tokens from which it is matched last.
MANY = 32
#: 8 bytes each.
BROADCAST_WINDOWS = 4_000_000
BITMAP_BITS = 24
WORD_CACHE = 500_000
# Units, and numbers as words.
UNITS = frozenset(
    "kg g mg lb lbs oz ton tons km m cm mm mi mile miles ft foot feet inch inches yd yard yards l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent dollar dollars euro euros "
    "cent cents pound pounds degree degrees watt watts volt volts newton newtons joule joules hz khz mhz ghz kb mb gb tb".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/-]*(?:%|[A-Za-z°]{0,3})")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
NUM, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)


class Words:
    """Number of every word, with its hash and what it can stand for; starts anew when full."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.text: list[str] = []
        self.hash = np.empty(1 << 16, np.uint64)
        self.flags = np.empty(1 << 16, np.uint8)  # 1 number, 2 capitalised, 4 unit, 8 ends a sentence, 16 nothing but marks

    def number(self, word: bytes) -> int:
        i = self.ids.get(word)
        if i is None:
            import xxhash

            i = self.ids[word] = len(self.text)
            raw = word.decode("utf-8", "replace")
            bare = _EDGE.sub("", raw)
            low = bare.lower()
            if i >= len(self.hash):
                self.hash, self.flags = np.resize(self.hash, 2 * len(self.hash)), np.resize(self.flags, 2 * len(self.flags))
            self.text.append(low)
            self.hash[i] = xxhash.xxh3_64_intdigest(low.encode()) | 8
            number = bool(_NUMBER.fullmatch(raw.strip("()[]{}\"'.,;:!?#*&"))) or low in NUMBER_WORDS
            self.flags[i] = number + 2 * (bare[:1].isupper() and not number) + 4 * (low in UNITS) + 8 * (raw.rstrip("\"')]}#*$%&")[-1:] in (".", "!", "?", ":")) + 16 * (not bare)
        return i

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.ids) > WORD_CACHE:
            self.__init__()
        get = self.ids.get
        return np.array([i if (i := get(t)) is not None else self.number(t) for t in tokens], np.int64)


def template(tokens: list[bytes], words: Words, first_is_start: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, template hashes) of the tokens that are not mere marks."""
    ids = words.numbers(tokens)
    flags = words.flags[ids] if len(ids) else np.empty(0, np.uint8)
    real = flags & 16 == 0
    ids, flags = ids[real], flags[real]
    h = words.hash[ids] if len(ids) else np.empty(0, np.uint64)
    after_end = np.empty(len(ids), bool)
    after_number = np.zeros(len(ids), bool)
    if len(ids):
        after_end[0] = first_is_start
        after_end[1:] = flags[:-1] & 8 > 0
        after_number[1:] = flags[:-1] & 1 > 0
    h = np.where(flags & 1 > 0, NUM, np.where((flags & 2 > 0) & ~after_end, NAME, np.where((flags & 4 > 0) & after_number, UNIT, h)))
    return ids, h


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` template tokens."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * _M1
        out ^= out >> np.uint64(29)
    return out * _M2


def _rows(ids: np.ndarray, h: np.ndarray, words: Words, at: np.ndarray, wh: np.ndarray, size: int):
    """(hash, position, values of its placeholders) of the windows at ``at``."""
    for p in at.tolist():
        slots = [words.text[ids[k]] for k in range(p, p + size) if h[k] <= UNIT]
        yield int(wh[p].view(np.int64)), p, slots


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(h, item, ipos, islots, size) of the windows of every item, with its first token in either form."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches):
        words = Words()
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = (text or "").encode().split()
                for start in (True, False):
                    ids, h = template(tokens, words, start)
                    size = min(window, len(h))
                    if size < min(SHORTEST, window):
                        continue
                    wh = windows(h, size)
                    out += [(x, item, p, s, size) for x, p, s in _rows(ids, h, words, np.arange(len(wh) if start else min(1, len(wh))), wh, size)]
            cols = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5
            kinds = (pa.int64(), batch.schema.field(0).type, pa.int32(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "item", "ipos", "islots", "size"])

    src = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("item is not null")
    return src.mapInArrow(run, f"h long, item {kind}, ipos int, islots array<string>, size int").dropDuplicates(["h", "item", "ipos"])


def document_windows(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], bitmap: np.ndarray, wanted: np.ndarray | None) -> DataFrame:
    """(h, doc, dpos, dslots) of the documents' windows that the benchmark may have."""
    kind = docs.schema[id_col].dataType.simpleString()
    shift = np.uint64(64 - BITMAP_BITS)
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, wanted))

    def run(batches):
        words = Words()
        bits, exact = shared.value
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                tokens = text.split() if text else []
                if len(tokens) < sizes[0]:
                    continue
                ids, h = template(tokens, words)
                for size in sizes:
                    wh = windows(h, size)
                    at = np.nonzero(bits[wh >> shift])[0]
                    if len(at) and exact is not None:
                        v = wh[at]
                        k = np.minimum(np.searchsorted(exact, v), len(exact) - 1)
                        at = at[exact[k] == v]
                    if len(at):
                        out += [(x, doc, p, s) for x, p, s in _rows(ids, h, words, at, wh, size)]
            cols = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4
            kinds = (pa.int64(), batch.schema.field(0).type, pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "doc", "dpos", "dslots"])

    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    return src.mapInArrow(run, f"h long, doc {kind}, dpos int, dslots array<string>")


def _matched(met: DataFrame, bench: DataFrame, share: float) -> DataFrame:
    """(doc, dpos, dslots, item, ipos, islots) of all windows that a document and an item share, of pairs that can reach ``share``.

    A window of more than ``MANY`` items meets an item that needs others beside such windows only in documents that have one of those.
    """
    items = bench.drop("size")
    many = items.groupBy("h").agg(F.count_distinct("item").alias("items")).where(f"items > {MANY}").select("h", F.lit(True).alias("hot"))
    if many.isEmpty():
        return met.join(items, "h")
    items = items.join(many, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    size = items.groupBy("item").agg((F.max("ipos") + 1).alias("n"), F.count_distinct(F.when(F.col("hot"), F.col("ipos"))).alias("k"))
    items = items.join(size.select("item", (F.col("k") < share * F.col("n")).alias("needs")), "item")
    first = met.join(items.where("not (hot and needs)").drop("hot"), "h")
    pairs = first.where("needs").select("doc", "item").distinct()
    second = met.join(many.drop("hot"), "h", "left_semi").join(pairs, "doc").join(items.where("hot and needs").drop("hot"), ["h", "item"])
    return first.select(*_MET).unionByName(second.select(*_MET))


_MET = ("doc", "dpos", "dslots", "item", "ipos", "islots")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: float = SHARE
) -> DataFrame:
    """(doc, item, matched, item_windows, exact) of documents that hold an item; exact: an occurrence has the item's own values."""
    from .common import keep

    bench = keep(benchmark_windows(benchmark, item_col, item_text_col, window))
    hashes = bench.select("h", "size").distinct()
    per_size = {r.size: r.n for r in hashes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    slots = hashes.select(F.shiftrightunsigned("h", 64 - BITMAP_BITS).alias("b")).distinct().toLocalIterator(prefetchPartitions=True)
    for r in slots:  # a fixed number at most
        bitmap[r.b] = True
    wanted = None
    if sum(per_size.values()) <= BROADCAST_WINDOWS:
        wanted = np.sort(np.array([r.h for r in hashes.select("h").distinct().toLocalIterator()], np.int64).view(np.uint64))
    sizes = sorted(per_size)
    if not sizes:
        sizes = [window]
        wanted = None
    met = keep(document_windows(docs, id_col, text_col, sizes, bitmap, wanted))
    # One row an alignment, no longer than the item; words have no spaces, so a pair of values is one string.
    groups = keep(
        _matched(met, bench, share)
        .groupBy("doc", "item", (F.col("dpos") - F.col("ipos")).alias("at"))
        .agg(F.collect_set("ipos").alias("ipos"), F.array_distinct(F.flatten(F.collect_list(F.zip_with("islots", "dslots", lambda i, d: F.concat(i, F.lit(" "), d))))).alias("pairs"))
    )
    size = bench.groupBy("item").agg((F.max("ipos") + 1).alias("item_windows"))
    enough = groups.groupBy("doc", "item").agg(F.sum(F.size("ipos")).alias("met")).join(size, "item").where(f"met >= {share} * item_windows").drop("met")
    groups = groups.join(enough, ["doc", "item"])
    near = groups.withColumn("at", F.explode(F.sequence(F.col("at") - DRIFT, F.col("at")))).groupBy("doc", "item", "item_windows", "at").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("ipos", "pairs")))
    value, as_value = F.transform("pairs", lambda p: F.substring_index(p, " ", 1)), F.transform("pairs", lambda p: F.substring_index(p, " ", -1))
    judged = groups.unionByName(near).select(
        "doc", "item", "item_windows", F.size("ipos").alias("matched"), F.forall("pairs", lambda p: F.substring_index(p, " ", 1) == F.substring_index(p, " ", -1)).alias("exact"),
        ((F.size("pairs") == F.size(F.array_distinct(value))) & (F.size("pairs") == F.size(F.array_distinct(as_value)))).alias("consistent"),
    )
    judged = judged.where(f"matched >= {share} * item_windows and consistent").drop("consistent")
    # All alignments together: parts of an item far from each other.
    parts = groups.select("doc", "item", F.explode("ipos").alias("ipos")).groupBy("doc", "item").agg(F.count_distinct("ipos").cast("int").alias("matched"))
    pairs = groups.select("doc", "item", F.explode("pairs").alias("p")).distinct().select("doc", "item", F.substring_index("p", " ", 1).alias("i"), F.substring_index("p", " ", -1).alias("d"))
    clash = pairs.groupBy("doc", "item").agg(F.bool_and(F.col("i") == F.col("d")).alias("exact"), F.count("*").alias("n"), F.count_distinct("i").alias("values"), F.count_distinct("d").alias("as_values"))
    whole = parts.join(clash, ["doc", "item"], "left").join(enough, ["doc", "item"]).where(f"matched >= {share} * item_windows and (n is null or n = values and n = as_values)")
    judged = judged.unionByName(whole.select("doc", "item", "item_windows", "matched", F.coalesce("exact", F.lit(True)).alias("exact")))
    return judged.groupBy("doc", "item").agg(F.max("matched").cast("long").alias("matched"), F.first("item_windows").cast("long").alias("item_windows"), F.bool_or("exact").alias("exact"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark."""
    gone = contaminated(docs, benchmark, id_col, **options).select(F.col("doc").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


def op9(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and an item that it holds."""
    return contaminated(docs, benchmark).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "matched", "item_windows", "exact")
