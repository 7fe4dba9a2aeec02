"""Scalar functions on text. Only what Spark has no function for is a pandas UDF (NFKC, casefold, width, scanning)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold())


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def ascii_norm(label: Column) -> Column:
    """``normalize_label`` of a label known to be ASCII: stays in the JVM."""
    return F.lower(F.trim(label))


def normalize_label(label: Column) -> Column:
    """NFKC, trim, casefold: the key of a concept in every session. '' for null."""
    return F.coalesce(F.pandas_udf(_nfkc_casefold, "string")(label), F.lit(""))


def normalize_message(message: Column) -> Column:
    """NFKC, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.pandas_udf(_nfkc, "string")(F.coalesce(message, F.lit(""))), r"[\s\p{Z}]+", " "))


def sha_prefix(value: Column, n: int) -> Column:
    """The first n hexadecimal digits of SHA-256."""
    return F.left(F.sha2(value.cast("binary"), 256), F.lit(n))


def sentence_id(document_id: Column, idx: Column, text: Column) -> Column:
    return F.concat_ws("#", document_id, F.lpad(idx.cast("string"), 4, "0"), sha_prefix(text, 8))


def member_fingerprint(members: Column, n: int = 16) -> Column:
    """Order-free hash of a set of members."""
    return sha_prefix(F.array_join(F.array_sort(F.array_distinct(members)), "\n"), n)


def label_digest(text: Column, n: int = 8) -> Column:
    return sha_prefix(F.coalesce(text, F.lit("")), n)


def nanopub_id(claim_text: Column, spans: Column) -> Column:
    """Stable id of a claim from its text and the first span's place."""
    first = F.get(spans, F.lit(0))
    return F.concat(F.lit("np-"), sha_prefix(F.concat_ws("|", claim_text, first["document_id"], first["char_start"].cast("string")), 16))


def first_hit(text: Column, cues: Sequence[str]) -> Column:
    """The first cue in order that is in the lower-cased text or in the text; null if none."""
    low = F.lower(text)
    out = None
    for c in cues:
        hit = low.contains(c) | text.contains(c)
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return F.lit(None).cast("string") if out is None else out


def any_hit(text: Column, cues: Iterable[str]) -> Column:
    return F.coalesce(first_hit(text, list(cues)).isNotNull(), F.lit(False))


def find_causal_cues(text: Column, lexicon: dict[str, Sequence[str]] | None = None) -> Column:
    """Sorted distinct ``category:cue`` of the cues found."""
    cues = [(c, w) for c, ws in (lexicon or S.CAUSAL_CUES).items() for w in ws]
    t = F.coalesce(text, F.lit(""))
    hits = F.array(*(F.when(F.lower(t).contains(w) | t.contains(w), F.lit(f"{c}:{w}")) for c, w in cues))
    return F.array_sort(F.array_distinct(F.array_compact(hits)))


def only_correlation(text: Column, lexicon: Sequence[str] = S.CORRELATION_ONLY) -> Column:
    return any_hit(F.coalesce(text, F.lit("")), lexicon)


def demoted_label(label: Column) -> Column:
    """The label without its leading mark; the neutral word if nothing is left."""
    bare = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"^[〜⚡⇒?]\s*", ""))
    return F.when(bare == "", "関連").otherwise(bare)


def claim_polarity(text: Column, cues: Sequence[str] = S.NEGATION_CUES) -> Column:
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    hit = F.lit(False)
    for c in cues:
        hit = hit | padded.contains(c.lower())
    return F.when(hit, "negative").otherwise("positive")


def opposite_split(a: Column, b: Column, pairs: Sequence[tuple[str, str]] = S.OPPOSITES) -> Column:
    """One of a pair of opposites is in one text and its counterpart in the other."""
    la, lb = F.lower(a), F.lower(b)
    hit = F.lit(False)
    for x, y in pairs:
        hit = hit | (la.contains(x) & lb.contains(y)) | (la.contains(y) & lb.contains(x))
    return hit


def epistemic_strength(confidences: Column, warrant: Column) -> Column:
    """struct(score, level): 0.4 min(1, n / 3) + 0.4 mean confidence + 0.2 with a warrant."""
    n = F.size(confidences)
    mean = F.when(n > 0, F.aggregate(confidences, F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)
    score = 0.4 * F.least(F.lit(1.0), n / 3) + 0.4 * mean + 0.2 * F.when(F.trim(F.coalesce(warrant, F.lit(""))) != "", 1.0).otherwise(0.0)
    score = F.round(score, 4)
    level = F.when(score >= 0.75, "strong").when(score >= 0.5, "moderate").when(score >= 0.3, "weak").otherwise("minimal")
    return F.struct(score.alias("score"), level.alias("level"))


def evidence_text(spans: Column) -> Column:
    """Trimmed surfaces joined by a space."""
    texts = F.filter(F.transform(spans, lambda s: F.trim(s["surface"])), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


def opposite_words(text: Column, pairs: Sequence[tuple[str, str]] = S.OPPOSITES) -> tuple[Column, Column]:
    """Numbers of the pairs of opposites whose first, and whose second, word is in the text: :func:`opposite_split` holds where those of one text meet the others of the other."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return tuple(F.filter(F.array(*(F.when(low.contains(p[k]), F.lit(i)) for i, p in enumerate(pairs))), lambda x: x.isNotNull()) for k in (0, 1))


def edge_text(spans: Column, label: Column) -> Column:
    """What the cue rules read: the surfaces and the label."""
    texts = F.filter(F.transform(spans, lambda s: s["surface"]), lambda t: t.isNotNull() & (t != ""))
    return F.concat_ws(" ", texts, F.when(label != "", label))


#: Characters that both texts have, if one is to count as within the other.
LEAST_CONTAINED = 8


def contained(a: Column, b: Column, least: int = LEAST_CONTAINED) -> Column:
    """Equal, or one contains the other and both have ``least`` characters."""
    both = F.least(F.length(a), F.length(b)) >= least
    return (a == b) | (both & (a.contains(b) | b.contains(a)))


def extract_text(name: Column, data: Column) -> Column:
    """Text of a file by its extension: markup of document XML is dropped, other bytes are UTF-8; '' for a PDF or a failure."""
    raw = F.coalesce(F.try_validate_utf8(data.cast("string")), F.regexp_replace(F.decode(data, "UTF-8"), "�", ""))
    xml = F.regexp_replace(F.regexp_replace(raw, "</w:p>", "\n"), "<[^>]+>", "")
    return F.when(name.rlike(r"(?i)\.pdf$"), "").when(name.rlike(r"(?i)\.(docx|xml)$"), xml).otherwise(F.coalesce(raw, F.lit("")))


# Sentence ends and brackets that protect them.
TERMINATORS = "。！？!?"
OPENERS, CLOSERS = "（(「『【［[", "）)」』】］]"
MAX_SENTENCE = 500


def sentence_spans(text: str | None, terminators: str = TERMINATORS, most: int = MAX_SENTENCE) -> list[tuple[int, int]]:
    """(start, end) of the trimmed sentences of a text, cut at ``most`` characters."""
    if not text or not text.strip():
        return []
    token = re.compile(rf"[{re.escape(OPENERS)}]|[{re.escape(CLOSERS)}]|[{re.escape(terminators)}]+|\n\s*")
    cuts, depth, at = [], 0, 0
    while m := token.search(text, at):
        at, t = m.end(), m[0]
        if t in OPENERS:
            depth += 1
        elif t in CLOSERS:
            depth = max(0, depth - 1)
        elif t[0] == "\n":
            if depth == 0 and t.count("\n") >= 2:
                cuts.append(at)
            elif depth:
                at = m.start() + 1
        elif depth == 0:
            cuts.append(at)
        else:
            at = m.start() + 1
    out, start = [], 0
    for end in [*cuts, len(text)]:
        a, b = _trimmed(text, start, end)
        for piece in range(a, b, most):
            s, e = _trimmed(text, piece, min(piece + most, b))
            if s < e:
                out.append((s, e))
        start = end
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), a + len(part.rstrip())


def split_sentences(text: Column, document_id: Column, terminators: str = TERMINATORS, most: int = MAX_SENTENCE) -> Column:
    """array<struct<sentence_id, idx, text, char_start, char_end>> of a text."""

    @F.pandas_udf("array<struct<idx:int,char_start:int,char_end:int>>")
    def spans(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"idx": i, "char_start": a, "char_end": b} for i, (a, b) in enumerate(sentence_spans(t, terminators, most))])

    def full(x: Column) -> Column:
        body = F.substring(text, x["char_start"] + 1, x["char_end"] - x["char_start"])
        return F.struct(sentence_id(document_id, x["idx"], body).alias("sentence_id"), x["idx"].alias("idx"), body.alias("text"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"))

    return F.transform(spans(text), full)


#: Ems kept free for an ellipsis, and of a line that reads well.
ELLIPSIS_WIDTH, LINE_WIDTH = 0.6, 12.0


def _width(c: str) -> float:
    return 1.0 if unicodedata.east_asian_width(c) in "WFA" else 0.55


def _widths(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else round(sum(map(_width, t)), 4))


def display_width(text: Column) -> Column:
    """Width in ems: 1 for a full-width character, 0.55 for any other."""
    return F.pandas_udf(_widths, "double")(text)


def truncate(text: Column, most: float) -> Column:
    """The text cut to a display width, with an ellipsis if something was cut."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None or sum(map(_width, t)) <= most:
                return t
            out, w = [], ELLIPSIS_WIDTH
            for c in t:
                if (w := w + _width(c)) > most:
                    break
                out.append(c)
            return "".join(out) + "…"

        return s.map(one)

    return cut(text)


def wrap_lines(text: Column, most: float, lines: int) -> Column:
    """The text in up to ``lines`` lines of a display width; what does not fit is cut from the last."""

    @F.pandas_udf("array<string>")
    def wrap(s: pd.Series) -> pd.Series:
        def one(t):
            out, line, w = [], [], 0.0
            for c in t or "":
                if w + _width(c) > most and line:
                    out.append("".join(line))
                    line, w = [], 0.0
                line.append(c)
                w += _width(c)
            out += ["".join(line)] if line else []
            return (out or [""]) if len(out) <= lines else [*out[: lines - 1], out[lines - 1][:-1] + "…"]

        return s.map(one)

    return wrap(text)


def balanced_lines(text: Column, most: int = 2) -> Column:
    """struct(lines, width): the fewest lines of an even width that reads well, ``most`` of them at most."""
    total = F.coalesce(display_width(text), F.lit(0.0))
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(total / LINE_WIDTH).cast("int")))
    return F.struct(n.alias("lines"), (total / n).alias("width"))


def extract_json(text: Column) -> Column:
    """The JSON value that the whole text is, else the first object in prose, else the first array, as text; null if there is none."""
    return F.pandas_udf(_json_of, "string")(text)


def _json_of(s: pd.Series) -> pd.Series:
    import json

    decoder = json.JSONDecoder()

    def value(t: str, at: int) -> str | None:
        try:
            return t[at : decoder.raw_decode(t, at)[1]]
        except ValueError:
            return None

    def one(t):
        t = (t or "").strip()
        if t and value(t, 0) == t:
            return t
        tries = (value(t, m.start()) for opening in (r"\{", r"\[") for m in re.finditer(opening, t))
        return next((v for v in tries if v is not None), None)

    return s.map(one)
