"""Quality rules with risk-controlled thresholds; DataFrame and SQL functions only.

Method. Every text gets metrics (``METRICS``), each of which tells against it as it grows. The joint rule of a stratum (language)
has levels, from loose to strict, fixed beforehand: a level has a cutoff for every metric, and rejects what is above one of them, so
what a level rejects all stricter ones reject. Levels are tested in this order on the labelled holdout: of the n good documents of the
stratum that pass the base rules, the level rejects k. The hypothesis "more than ``alpha`` of the good documents are rejected" is
refused if the exact binomial tail P(X <= k | n, alpha) is at most the stratum's share of delta; the first that is not refused ends the
sequence. Such a sequence needs no correction for its length; over the strata delta is shared by their numbers of good
labels (a weighted Bonferroni correction), so that with probability 1 - delta every chosen level keeps its promise at once. Of the levels that
pass, the loosest is used that rejects a share of ``ENOUGH`` of the most documents labelled bad that any of them rejects; a stratum without one rejects nothing by its metrics.

The bound supposes that the labelled documents of a stratum are drawn independently; copies among them count as often as
they occur, so where a holdout has many copies, label one of each class.

Defined results: a null, empty or blank text has no words and fails the base rules; a text may have any length; a
document without a stratum, or of one without labels, is judged by the base rules only; a document labelled twice counts
once, as good if it is good once; rows repeat as they are; a row without an id is judged by its own text and teaches nothing; an empty table gives no
row; extra columns are ignored (kept by :func:`kept_documents`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

ALPHA, DELTA = 0.02, 0.05
ENOUGH = 0.98
#: Metric -> cutoffs of the levels in whole thousandths: what a document has above the cutoff rejects it.
METRICS = {
    "symbols": (2000, 1000, 600, 400, 300, 200, 150, 100, 50, 20, 10),  # symbols a word
    "repeats": (300, 290, 280, 270, 260, 250, 225, 200, 150, 100, 50),  # words in repeated windows
    "dup_lines": (900, 800, 700, 600, 550, 500, 450, 400, 300, 200, 100),  # lines equal to an earlier one
    "long_words": (12000, 10000, 9000, 8000, 7500, 7000, 6800, 6500, 6250, 6000, 5500),  # characters a word
    "short_words": (-2500, -2750, -3000, -3200, -3400, -3500, -3750, -4000, -4250, -4350, -4500),  # characters a word, negated
}
LEVELS = 11
#: Ids of labelled documents are broadcast up to this number; beyond it the metrics are joined with them by id.
BROADCAST_LABELS = 1_000_000
#: Rows of the table of levels (a row for a language) are broadcast up to this number.
BROADCAST_STRATA = 100_000
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _windows() -> str:
    """SQL of the hashes of all windows of 8 of the words w, from those of 1, 2 and 4."""
    out = "transform(w, x -> xxhash64(x))"
    for k in (1, 2, 4):
        pair = f"zip_with(slice(h{k}, 1, greatest(size(h{k}) - {k}, 0)), slice(h{k}, {k + 1}, size(h{k})), (a, b) -> xxhash64(a, b))"
        out = _let(out, f"h{k}", pair)
    return out


def _repeated() -> str:
    """SQL of the words in windows h that occur twice or more: each start covers 8 words or those up to the next start."""
    sorted_ = "sort_array(zip_with(h, sequence(0, size(h) - 1), (x, i) -> struct(x as h, i as i)))"
    again = "coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)"
    starts = f"sort_array(transform(filter(zip_with(s, sequence(0, size(s) - 1), (x, k) -> struct(x.i as i, {again} as d)), x -> x.d), x -> x.i))"
    covered = f"aggregate({_let(sorted_, 's', starts)}, struct(0L as n, -{WINDOW} as last), (a, i) -> struct(a.n + least({WINDOW}, i - a.last) as n, i as last), a -> a.n)"
    return f"case when size(array_distinct(h)) = size(h) then 0L else {covered} end"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text and with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    made = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    others = [c for c in docs.columns if c not in (*made, text_col)]
    lines = r"filter(split(t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"
    counts = ", ".join(
        f"cast({v} as bigint) as {k}"
        for k, v in {
            "n_words": "size(w)",
            "word_chars": "length(array_join(w, ''))",
            "n_symbols": "length(t) - length(translate(t, '#*$%&|<>', ''))",
            "n_lines": "size(l)",
            "n_dup_lines": "size(l) - size(array_distinct(l))",
            "n_repeat_words": _let(_windows(), "h", _repeated()),
        }.items()
    )
    words = f"filter(split(t, r'{SPACES}'), x -> x <> '')"
    m = _let(f"coalesce(`{text_col}`, '')", "t", _let(words, "w", _let(lines, "l", f"struct({counts})")))
    out = docs.select(*(F.col(c) for c in others), F.expr(m).alias("_m"))
    return out.select(*others, *(F.col("_m")[c].alias(c) for c in made))


def _scores() -> dict[str, str]:
    """Metrics in whole thousandths, as SQL; 0 words are left to the base rules."""
    per = lambda x, n: f"case when {n} > 0 then ({x}) * 1000 div {n} else 0 end"
    return {
        "symbols": per("n_symbols", "n_words"),
        "repeats": per("n_repeat_words", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "long_words": per("word_chars", "n_words"),
        "short_words": "case when n_words > 0 then -(word_chars * 1000 div n_words) else -1000000 end",
    }


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def _reached() -> str:
    """SQL of the first level that rejects a row, null if none does."""
    return "case " + " ".join(f"when {' or '.join(f'{m} > {c[i]}' for m, c in METRICS.items())} then {i + 1}" for i in range(LEVELS)) + " end"


def _scored(docs: DataFrame) -> DataFrame:
    rows = measured(docs).selectExpr("*", f"{BASE_FAILED} as base_failed", *(f"{v} as {k}" for k, v in _scores().items()))
    return rows.selectExpr("*", f"{_reached()} as reached")


def _tail(rate: float) -> str:
    """SQL of P(X <= k | n, rate) by the ratio of successive terms, in logarithms; 1 where k is above the mean."""
    term = f"ln((n - i + 1d) / i) + ln({rate}d / (1 - {rate}d))"
    sum_ = f"aggregate(sequence(1, cast(k as int)), struct(n * ln(1 - {rate}d) as t, exp(n * ln(1 - {rate}d)) as p), (a, i) -> struct(a.t + {term} as t, a.p + exp(a.t + {term}) as p), a -> a.p)"
    return f"case when k >= n * {rate}d then 1d when k = 0 then exp(n * ln(1 - {rate}d)) else {sum_} end"


def choose(labelled: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, level, n, k) from scored labelled rows with a column ``good``; strata that no level passes are not there."""
    counts = labelled.where(f"{stratum} is not null and not base_failed").groupBy(F.col(stratum).alias("stratum")).pivot("reached", list(range(1, LEVELS + 1)))
    counts = counts.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    size = labelled.where(f"{stratum} is not null and not base_failed").groupBy(F.col(stratum).alias("stratum")).agg(F.count_if("good").alias("n"))
    counts = keep(size.where("n > 0").join(counts, "stratum"))  # a row for a stratum
    total = counts.agg(F.sum("n")).first()[0] or 1
    up_to = lambda kind, i: " + ".join(f"coalesce(`{j}_{kind}`, 0)" for j in range(1, i + 1))
    levels = f"inline(array({', '.join(f'struct({i} as level, {up_to("good", i)} as k, {up_to("bad", i)} as bad)' for i in range(1, LEVELS + 1))}))"
    tested = counts.selectExpr("stratum", "n", levels).selectExpr("*", f"{_tail(alpha)} as p")
    # What a level rejects grows from level to level, and so does p: no level after the first failure passes.
    passed = tested.where(f"p <= {delta}d * n / {total}")
    most = F.max("bad").over(Window.partitionBy("stratum"))  # of a row for a level
    enough = passed.withColumn("most", most).where(f"bad >= {ENOUGH}d * most")
    return enough.groupBy("stratum").agg(F.min_by(F.struct("level", "n", "k"), "level").alias("c")).select("stratum", "c.*")


def _verdicts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Scored ``rows`` with the failed rules and ``kept``, without the scores."""
    table = cuts.select("stratum", "level")
    out = rows.join(F.broadcast(table) if table.count() <= BROADCAST_STRATA else table, "stratum", "left")
    above = lambda m: F.col(m) > F.element_at(F.array(*map(F.lit, METRICS[m])), F.col("level"))
    failed = F.array_compact(F.array(*(F.when(above(m), F.lit(m)) for m in METRICS)))
    out = out.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("reached") <= F.col("level"), F.lit(False)))
    return out.drop(*METRICS, "reached", "level")


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum: str, alpha: float, delta: float) -> tuple[DataFrame, DataFrame]:
    """The scored rows of ``docs``, each text read once, and the cutoffs."""
    rows = keep(_scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum).alias("stratum"))))
    told = keep(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good")))
    labelled = rows.join(F.broadcast(told) if told.count() <= BROADCAST_LABELS else told, "doc_id")
    return rows, keep(choose(labelled, "stratum", alpha, delta))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(id, stratum, the metrics' counts, base_failed, kept, failed rules) of every row of ``docs``."""
    return _verdicts(*_fitted(docs, labels, id_col, text_col, stratum, alpha, delta))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` without those that a rule rejects; rows that share an id go or stay together, a row without an id alone."""
    rows, cuts = _fitted(docs, labels, id_col, text_col, stratum, alpha, delta)
    gone = keep(_verdicts(rows, cuts).where("not kept").select(F.col("doc_id").alias(id_col)).distinct())
    named = docs.join(gone.where(F.col(id_col).isNotNull()), id_col, "left_anti")
    if gone.where(F.col(id_col).isNull()).isEmpty():
        return named.select(*docs.columns)
    bare = docs.where(F.col(id_col).isNull()).select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(stratum).alias("stratum"))
    bare = _verdicts(_scored(bare), cuts).where("kept").select("row.*")
    return named.where(F.col(id_col).isNotNull()).select(*docs.columns).unionByName(bare)


def op6(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns over ``documents``."""
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs, labels).select(*cols)
