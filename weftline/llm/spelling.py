"""Groups of spelling variants by a trie self-join with active-node sets.

Method. The vocabulary is sorted and cut into ranges of about ``TASK_CHARS`` code points, so that each range is a piece of
the trie of all words. In a range the trie is walked from the top. Every node carries its active set: the nodes whose
strings are at distance one of its own. A child of v by c inherits, of each active node of v, the child by c; new in its set
are its elder siblings (a replacement) and v itself (an insertion of c). With a bound of one nothing else can become
active. Where two terminal nodes are active, their words are near. A pair becomes active at its longest common prefix
only, so it is found once.

Pairs whose words lie in different ranges part at a node that the ranges share, a prefix of the last word of one and the
first word of the next. These nodes, the spine, are few (a handful for a border). Below the node where it began, an active
pair goes on by equal characters only, so words meet there in a join on (node, rest after the replaced or inserted
character). Such a group has one word for each letter of the alphabet at most, and one without the letter.

The form of a word is its near word with the most occurrences (ties: the least in code-point order), if it has ``RATIO``
times as many or more; the root is where the forms end. Occurrences grow along the forms, so they have no cycle and less
than log2 of the largest count steps.

Defined results: null and empty texts have no words; words may have any length; rows repeat as they are, each counts; an
empty table gives no row; results do not depend on the order of rows; extra columns are ignored. For the query, a null id reads as
the empty string.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep, slices

LEAST_CHARS, LEAST_COUNT, RATIO = 5, 3, 2
#: Code points of the words of one range, about; the trie of a range takes some 100 bytes for each.
TASK_CHARS = 500_000
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 300_000
#: Words with a form are broadcast up to this number (some 100 bytes each).
BROADCAST_FORMS = 1_000_000
#: Letters of UTF-8 texts whose A-Z are lower-cased: a-z and U+00C0 to U+00FF.
RUNS = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF])+")
#: Stands for the replaced or inserted letter; no word has it.
HOLE = "\0"


def runs(doc_id, text: bytes) -> Iterable[tuple[bytes, int]]:
    """The words of a text with their counts; only A-Z are lower-cased."""
    return Counter(RUNS.findall(text.lower())).items()  # of bytes: A-Z only


def runs_with_slips(doc_id, text: bytes) -> Iterable[tuple[bytes, int]]:
    """As :func:`runs`; where 97 divides h, the crc32 of id, colon and word, the word's code point h % length is left out."""
    seed = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
    for word, n in runs(doc_id, text):
        h = zlib.crc32(word, seed)
        if h % 97 == 0:
            s = word.decode()
            at = h % len(s)
            word = (s[:at] + s[at + 1 :]).encode()
        yield word, n


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of: Callable = runs, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT
) -> DataFrame:
    """(word, n) of all texts, added up in the tasks before the shuffle."""

    def run(batches):
        held: Counter = Counter()

        def batch_of(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for word, n in words_of(i, text) if text else ():
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield batch_of(held)
                held.clear()
        if held:
            yield batch_of(held)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") >= least_chars) & (F.col("n") >= least_count))


def trie_pairs(words: list[str], emit: Callable[[int, int], None]) -> None:
    """Calls ``emit`` once for each pair of places in the sorted distinct ``words`` that are at distance one.

    A node is (lo, hi, depth): the words from lo to hi, which share their first ``depth`` characters.
    """
    place = {w: i for i, w in enumerate(words)}
    seen: dict[tuple[int, int], dict[str, tuple[int, int]]] = {}

    def children(lo: int, hi: int, depth: int) -> dict[str, tuple[int, int]]:
        out = seen.get((lo, depth))
        if out is None:
            out, at = {}, lo + (len(words[lo]) == depth)
            while at < hi:
                c, start = words[at][depth], at
                while at < hi and words[at][depth] == c:
                    at += 1
                out[c] = (start, at)
            seen[lo, depth] = out
        return out

    # An active node is (lo, hi, depth, the character that may not come next, as the pair would have begun further down).
    todo = [(0, len(words), 0, [])] if words else []
    while todo:
        lo, hi, depth, active = todo.pop()
        if hi - lo == 1:  # one word is left: look its rest up below the active nodes
            rest = words[lo][depth:]
            for a, b, d, but in active:
                if rest[:1] == but and but:
                    continue
                if b - a == 1:
                    if words[a][d:] == rest:
                        emit(lo, a)
                else:
                    at = place.get(words[a][:d] + rest, -1)
                    if a <= at < b:
                        emit(lo, at)
            continue
        if len(words[lo]) == depth:
            for a, _, d, _ in active:
                if len(words[a]) == d:
                    emit(lo, a)
        elder = []
        for c, (start, end) in children(lo, hi, depth).items():
            below = [(lo, hi, depth, c), *elder]
            for a, b, d, but in active:
                if but == c:
                    continue
                if b - a == 1:
                    if words[a][d : d + 1] == c:
                        below.append((a, b, d + 1, ""))
                elif at := children(a, b, d).get(c):
                    below.append((*at, d + 1, ""))
            todo.append((start, end, depth + 1, below))
            elder.append((start, end, depth + 1, ""))


def _near_in_ranges(ranged: DataFrame) -> DataFrame:
    """(part, word, n, n_near, best: -n and word of the best near one) for every word of sorted ranges, within the ranges."""

    def run(batches):
        from pyspark import TaskContext

        words, counts = [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
        near, best = [0] * len(words), [None] * len(words)

        def emit(i: int, j: int):
            for x, y in ((i, j), (j, i)):
                near[x] += 1
                b = best[x]
                if b is None or (-counts[y], y) < (-counts[b], b):
                    best[x] = y

        trie_pairs(words, emit)
        if words:
            said = [None if b is None else {"minus": -counts[b], "word": words[b]} for b in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()] * len(words), pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(near, pa.int64()),
                 pa.array(said, pa.struct([("minus", pa.int64()), ("word", pa.string())]))],
                names=["part", "word", "n", "n_near", "best"],
            )

    return ranged.mapInArrow(run, "part int, word string, n long, n_near long, best struct<minus: bigint, word: string>")


def _common(a: str, b: str) -> str:
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return a[:k]


def _spine(local: DataFrame) -> frozenset[str]:
    """The nodes that two ranges or more share; of every range only its first and last word come to the driver."""
    ends = sorted((r.lo, r.hi) for r in local.groupBy("part").agg(F.min("word").alias("lo"), F.max("word").alias("hi")).toLocalIterator())
    shared = (_common(a[1], b[0]) for a, b in zip(ends, ends[1:]))
    return frozenset(s[:k] for s in shared for k in range(len(s) + 1))


def _near_across(local: DataFrame, spine: frozenset[str]) -> DataFrame:
    """(word, n_near, best) by near words in other ranges."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for part, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for k in range(len(word) + 1):
                    if word[:k] not in spine:
                        break
                    rows = [(word[:k] + HOLE + word[k:], HOLE + word[k : k + 1])]
                    if k < len(word):
                        rows.append((word[:k] + HOLE + word[k + 1 :], word[k]))
                    for key, letter in rows:
                        for c, v in zip(out, (key, letter, word, n, part), strict=True):
                            c.append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "letter", "word", "n", "part"])

    keyed = local.select("part", "word", "n").mapInArrow(run, "key string, letter string, word string, n long, part int")
    # Of the word without the letter, ``letter`` is the hole and the next letter: that one would be inserted further on.
    groups = keyed.groupBy("key").agg(F.collect_list(F.struct("part", "letter", "word", "n")).alias("g"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    met = f"filter(g, y -> y.part <> x.part and y.letter <> concat('{HOLE}', x.letter) and x.letter <> concat('{HOLE}', y.letter))"
    near = groups.selectExpr(f"explode(transform(g, x -> struct(x.word as word, transform({met}, y -> struct(-y.n as minus, y.word as word)) as near))) as r")
    return near.where("size(r.near) > 0").selectExpr("r.word as word", "cast(size(r.near) as long) as n_near", "array_min(r.near) as best")


def near_words(vocab: DataFrame, tmp: Scratch, task_chars: int = TASK_CHARS) -> DataFrame:
    """(word, n, n_near, best) of a vocabulary of distinct words: how many are at distance one, and -n and word of the best of them."""
    vocab = tmp.write(vocab, "vocabulary")
    chars = vocab.agg(F.sum(F.length("word"))).first()[0] or 0
    ranged = vocab.select("word", "n").repartitionByRange(max(1, -(-chars // task_chars)), "word").sortWithinPartitions("word")
    local = tmp.write(_near_in_ranges(ranged), "ranges")
    spine = _spine(local)
    if not spine:
        return local.select("word", "n", "n_near", "best")
    across = _near_across(local, spine).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best")
    both = local.select("word", "n", "n_near", "best").unionByName(across)
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(vocab: DataFrame, ratio: int = RATIO, task_chars: int = TASK_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words."""
    with Scratch(vocab.sparkSession, "spelling") as tmp:
        near = near_words(vocab, tmp, task_chars)
        has = F.coalesce(-F.col("best.minus") >= ratio * F.col("n"), F.lit(False))
        near = tmp.write(near.select("word", "n", "n_near", F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n")), "near")
        # Pointer jumping over the words that have a form: after r rounds ``up`` is 2^r steps on, or the last.
        up, r = tmp.write(near.where("form is not null").selectExpr("word", "form as up"), "up0"), 0
        small = up.count() <= BROADCAST_FORMS
        while True:
            on = up.selectExpr("word as up", "up as further")
            r += 1
            new = tmp.write(up.join(F.broadcast(on) if small else on, "up", "left").selectExpr("word", "coalesce(further, up) as up", "further is not null as moved"), f"up{r}")
            up = new.select("word", "up")
            if new.where("moved").isEmpty():
                break
        out = near.join(F.broadcast(up) if small else up, "word", "left")
        return keep(out.select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n"))


def op11(spark, docs: DataFrame) -> DataFrame:
    """The contract's columns over ``documents``."""
    return variants(vocabulary(docs, words_of=runs_with_slips))
