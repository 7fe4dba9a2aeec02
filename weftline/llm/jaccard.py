"""Exact n-gram Jaccard self-join by adaptive multi-match prefixes, and its connected components.

Method. A text becomes the set of its distinct word n-grams (64-bit hashes of the lower-cased words), in the
order of those hashes, which stands for a random global order. Two sets with Jaccard at least ``num``/``den``
share t = ceil(num * n / den) members at least, so for every l the first l common members lie within the first
n - t + l members of both (the l-prefix), and the coldest common member of an l-prefix survives in both when each
side drops the l - 1 most frequent members of its own. All documents start with a short prefix. The cost of one that
keeps nothing which another document keeps is 0: it is done. One whose lists are all short (``CHEAP`` documents) meets
the documents in them. The others lengthen their prefixes to the next level, where correspondingly more of it must be
shared (so that more of the frequent members are dropped): the whole set, in whose order of frequency the places of a
common member must leave room for enough others. Before the exact test every pair must also share the l members of its
first prefixes.

Equal sets are joined first, by digest. Links are then verified in rounds: in every posting list one hub is
compared with all others; lists that are not settled by that (their members have several labels) get further
hubs, and in the end every pair of differently labelled members in such a list. So no pair with the required
similarity is missed, unless its ends are connected already, and a posting list of near copies costs its length
instead of its square.

Defined results: a null, empty or blank text has the empty set and links with nothing; with fewer words than n the
whole sequence is one member; a text may have any length; rows that repeat an id give a row each and count as one document,
if their texts differ that of the set with the least digest; a row without an id is linked as any other and has a null class if nothing that it reaches has an id; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch, keep, slices

#: Ids of candidates are broadcast up to this number (16 bytes each in Spark's hashed form: some 100 MB); beyond it they are shuffled.
BROADCAST_IDS = 1_000_000
#: Matches l that a level asks for with prefix length p: 1 + x * p + y; None: as many as the whole set must share.
LEVELS = ((0.25, 4), None)
#: Documents in a list that are met without a longer prefix.
CHEAP = 16
#: Words whose hashes a Python worker remembers.
WORD_CACHE = 500_000

#: Names of rows without an id begin with, or are at least; ids must not.
NAMELESS, NAMELESS_LONG = "\U0010ffff", 3 << 61

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to WORD_CACHE of them."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes (int64) of the word n-grams of a UTF-8 text."""
    tokens = text.lower().split() if text else []  # of bytes: A-Z only, and the six ASCII white spaces
    if not tokens:
        return np.empty(0, np.int64)
    a = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    k = min(n, len(a))
    h = np.full(len(a) - k + 1, np.uint64(k))
    for i in range(k):
        h = _mix(h * _M1 + a[i : len(a) - k + 1 + i])
    return np.unique(h.view(np.int64))


def threshold(n, num: int, den: int):
    """Common members that a set of n needs at least: ceil(num * n / den)."""
    return -(-num * n // den)


def _list_array(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, level: int | None = None) -> DataFrame:
    """doc, n, digest of the set, and its first members: all, or the prefix that ``level`` asks for."""

    def run(batches):
        words = WordHashes()
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, n, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            counts = [len(s) for s in sets]
            if level is not None:
                sets = [s[: prefix(len(s), num, den, level)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), pa.array(digests, pa.binary()), _list_array(sets)], names=["doc", "n", "digest", "grams"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc {kind}, n int, digest binary, grams array<bigint>")


def _named(sets: DataFrame) -> DataFrame:
    """``sets`` with a name for rows without an id, by their set: greater than all ids in use, so it never names a class that has an id."""
    kind = sets.schema["doc"].dataType
    own = F.concat(F.lit(NAMELESS), F.hex("digest")) if isinstance(kind, StringType) else (F.lit(NAMELESS_LONG) + F.shiftrightunsigned(F.xxhash64("digest"), 3)).cast("long")
    doc = F.col("doc") if isinstance(kind, StringType) else F.col("doc").cast("long")
    return sets.withColumn("doc", F.coalesce(doc, F.when(F.col("digest").isNotNull(), own)))


def _nameless(c: Column, sets: DataFrame) -> Column:
    return c.startswith(NAMELESS) if isinstance(sets.schema["doc"].dataType, StringType) else c >= NAMELESS_LONG


def prefix(n: int, num: int, den: int, level: int) -> int:
    """Members of the l-prefix of a set of n at a level."""
    t = threshold(n, num, den)
    if LEVELS[level] is None:
        return n
    x, y = LEVELS[level]
    return min(n, n - t + 1 + min(int(x * (n - t + 1)) + y, max(t - 1, 0)))


def _sql(num: int, den: int, level: int, n: str = "n") -> tuple[str, str]:
    """SQL of the matches l at a level and of the length of the l-prefix for l = 0, of a set of ``n`` members."""
    t = f"cast(({num} * cast({n} as bigint) + {den - 1}) div {den} as int)"
    if LEVELS[level] is None:
        return t, f"({n} - {t})"
    x, y = LEVELS[level]
    return f"(1 + least(cast(floor({x}d * ({n} - {t} + 1)) as int) + {y}, {t} - 1))", f"({n} - {t})"


def _kept(reps: DataFrame, num: int, den: int, level: int) -> DataFrame:
    """(doc, n, cost, pos, gram): the l-prefix's members that others have too, less the l - 1 most frequent ones.

    At the last level ``pos`` is the member's place in the order of frequency, from 1.
    """
    raw = reps.select(F.explode("grams").alias("gram"), "doc")
    shared = raw.groupBy("gram").agg(F.count("*").alias("cnt")).where("cnt > 1")
    met = raw.join(shared, "gram").groupBy("doc").agg(F.collect_list(F.struct("cnt", "gram")).alias("met"))
    need, _ = _sql(num, den, level)
    # Members that nobody shares are the least frequent ones: only what exceeds l - 1 shared members stays.
    kept = met.join(reps.select("doc", "n"), "doc").selectExpr("doc", "n", "aggregate(met, 0L, (s, x) -> s + x.cnt) as cost", f"slice(sort_array(met, false), {need}, 2147483647) as kept")
    return kept.selectExpr("doc", "n", "cost", "posexplode(kept.gram) as (k, gram)").selectExpr("doc", "n", "cost", f"n - {need} + 1 - k as pos", "gram")


def _one_text(sets: DataFrame) -> DataFrame:
    """One set for each doc: that of the least digest, empty ones last."""
    others = [c for c in sets.columns if c != "doc"]
    return sets.groupBy("doc").agg(F.min_by(F.struct(*others), F.struct(F.col("digest").isNull(), "digest")).alias("s")).select("doc", "s.*")


def _lists(post: DataFrame) -> DataFrame:
    """The postings in lists of two or more, with the length m of the list."""
    return post.join(post.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "gram")


def _of(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``table`` whose doc is in ``ids`` (doc), sent to all executors if they are few."""
    few = ids.count() <= BROADCAST_IDS
    return table.join(F.broadcast(ids) if few else ids, "doc", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, tmp: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that have the similarity: first enough shared members of the base prefixes, then the exact test."""
    need, before = _sql(num, den, 0)
    sides = {s: sets.selectExpr(f"doc as {s}", f"slice(grams, 1, {before} + {need}) as p{s}", f"{need} as l{s}", f"{before} as b{s}") for s in "ab"}
    near = pairs.join(sides["b"], "b").join(sides["a"], "a").withColumn("l", F.least("la", "lb"))
    near = tmp.write(near.where("size(array_intersect(slice(pa, 1, ba + l), slice(pb, 1, bb + l))) >= l").select("a", "b"), f"near{name}")
    used = _of(near.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), sets)
    ga, gb = (used.selectExpr(f"doc as {s}", f"grams as g{s}", f"n as n{s}") for s in "ab")
    both = near.join(gb, "b").join(ga, "a").selectExpr("a", "b", "na", "nb", "cast(size(array_intersect(ga, gb)) as bigint) as same")
    return tmp.write(both.where(f"same * {den} >= {num} * (na + nb - same)").select("a", "b"), f"links{name}")


def _close(a: str, b: str, num: int, den: int) -> str:
    """SQL: sets with sizes n and places pos of a common member, their first, may have the similarity."""
    na, nb = (f"cast({x}n as bigint)" for x in (a, b))
    most = f"1 + least({na} - {a}pos, {nb} - {b}pos)"
    return f"{den} * least({na}, {nb}) >= {num} * greatest({na}, {nb}) and {most} >= ({num} * ({na} + {nb}) + {num + den - 1}) div {num + den}"


def components(links: DataFrame, tmp: Scratch, name: str, steps: int = 0) -> DataFrame:
    """(doc, component): the least doc reachable over links (a, b); by least labels of neighbours and pointer jumping.

    With ``steps``, the labels after so many steps: connected still, but perhaps not yet the least.
    """
    both = tmp.write(links.select("a", "b").unionByName(links.selectExpr("b as a", "a as b")), f"{name}-both")
    label = tmp.write(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as doc", "least(a, m) as component"), f"{name}-0")
    done = 0
    while True:
        near = both.join(label.selectExpr("doc as b", "component as c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = label.join(near, label.doc == near.a).selectExpr("doc", "component as was", "least(component, c) as c")
        jump = step.selectExpr("doc as c", "c as up")
        done += 1
        new = tmp.write(step.join(jump, "c", "left").selectExpr("doc", "was", "least(c, coalesce(up, c)) as component"), f"{name}-{done}")
        tmp.drop(f"{name}-{done - 2}")
        label = new.select("doc", "component")
        if done == steps or new.where("was <> component").isEmpty():
            return label


def similarity_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, hub_rounds: int = 3
) -> DataFrame:
    """(doc, n_shingles, component) of every row of ``docs``: classes of texts connected by Jaccard >= num / den."""
    spark = docs.sparkSession
    with Scratch(spark, "jaccard") as tmp:
        return _components(docs, id_col, text_col, n, num, den, hub_rounds, tmp)


def _components(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, hub_rounds: int, tmp: Scratch) -> DataFrame:
    all_sets = tmp.write(_named(shingle_sets(docs, id_col, text_col, n, num, den, 0)), "prefixes")
    member = tmp.write(all_sets.where("digest is not null").groupBy("digest").agg(F.min("doc").alias("rep")), "members")
    reps = all_sets.join(member.select(F.col("rep").alias("doc")), "doc", "left_semi")
    repeated = not all_sets.groupBy("doc").count().where("count > 1").isEmpty()
    if repeated:
        reps = _one_text(reps)
    kept = tmp.write(_kept(reps, num, den, 0).select("doc", "n", "cost", "gram"), "kept0")
    base = tmp.write(_lists(kept), "base")
    tmp.drop("kept0")
    wanted = tmp.write(base.groupBy("doc").agg((F.max("m") > CHEAP).alias("long")), "wanted")
    texts = docs.select(F.col(id_col).cast(all_sets.schema["doc"].dataType).alias("doc"), F.col(text_col).alias("text"))
    sets = shingle_sets(_of(wanted.select("doc"), texts), "doc", "text", n, num, den)
    if not wanted.where(_nameless(F.col("doc"), all_sets)).isEmpty():
        sets = sets.unionByName(_of(wanted.select("doc"), _named(shingle_sets(texts.where("doc is null"), "doc", "text", n, num, den))))
    if repeated:
        sets = _one_text(sets)
    sets = tmp.write(sets.select("doc", "n", "grams"), "sets")
    short = base.where(f"m <= {CHEAP}").join(wanted, "doc")
    whole = _lists(_kept(_of(wanted.where("long").select("doc"), sets), num, den, 1)).withColumn("long", F.lit(True))
    cols = ["gram", "doc", "n", "cost", "pos", "long"]
    post = short.withColumn("pos", F.lit(1)).selectExpr("0 as lvl", *cols).unionByName(whole.selectExpr("1 as lvl", *cols))
    post = tmp.write(post, "lists")
    tmp.drop("base")

    links = label = None
    for r in range(hub_rounds + 1):
        named = post.withColumn("label", F.col("doc")) if label is None else post.join(label, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        # The first hub of a list is its most typical member, who has most in common with others; later ones are any.
        hub = F.struct(F.col("cost") if r == 0 else F.xxhash64("doc", F.lit(r)), "doc", "n", "pos", "label", "long")
        mixed = named.groupBy("lvl", "gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(hub).alias("hub")).where("lo <> hi")
        if r < hub_rounds:
            met = named.join(mixed.select("lvl", "gram", "hub"), ["lvl", "gram"]).where(f"label <> hub.label and (lvl = 1 or not (long and hub.long)) and {_close('', 'hub.', num, den)}")
            met = met.selectExpr("least(doc, hub.doc) as a", "greatest(doc, hub.doc) as b")
        else:
            live = tmp.write(named.join(mixed.select("lvl", "gram"), ["lvl", "gram"]), "live")
            per = live.groupBy("lvl", "gram", "label").agg(F.count("*").alias("k"))
            major = per.groupBy("lvl", "gram").agg(F.max(F.struct("k", "label")).alias("m")).selectExpr("lvl", "gram", "m.label as major")
            minor = live.join(major, ["lvl", "gram"]).where("label <> major").selectExpr("lvl", "gram", "major", "doc as x", "n as xn", "pos as xpos", "label as lx", "long as longx")
            met = minor.join(live, ["lvl", "gram"]).where(f"label <> lx and (label = major or doc < x) and (lvl = 1 or not (long and longx)) and {_close('', 'x', num, den)}")
            met = met.selectExpr("least(doc, x) as a", "greatest(doc, x) as b")
        found = _verified(met.distinct(), sets, num, den, tmp, str(r))
        links = found if links is None else links.unionByName(found)
        if r < hub_rounds:
            label = tmp.write(components(links, tmp, f"comp{r}", 2).select("doc", F.col("component").alias("label")), f"labels{r}")
    comp = components(links, tmp, "comp")
    by_digest = member.join(comp.withColumnRenamed("doc", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = all_sets.select("doc", "n", "digest").join(by_digest, "digest", "left")
    out = out.select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))
    named = lambda c: F.when(~_nameless(F.col(c), all_sets), F.col(c)).cast(docs.schema[id_col].dataType).alias(c)
    return keep(out.select(named("doc"), "n_shingles", named("component")))


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class of :func:`similarity_components`: that of the least id; rows without an id stay."""
    comp = similarity_components(docs, id_col, **options)
    gone = comp.where("doc <> component").select(F.col("doc").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op7(spark, docs: DataFrame) -> DataFrame:
    """The contract's columns of the join over ``documents``."""
    return similarity_components(docs).selectExpr("doc as doc_id", "n_shingles", "component as component_id")
