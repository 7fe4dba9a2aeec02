"""DuckDB SQL of the operators that SQL can express on whole tables; the others are tested against brute force."""

from __future__ import annotations

from .quality import ALPHA, DELTA, ENOUGH, LEVELS, METRICS


def _quality() -> str:
    """The metrics by joins over words, the levels by the binomial tail with lgamma."""
    reached = "CASE " + " ".join(f"WHEN {' OR '.join(f'{m} > {c[i]}' for m, c in METRICS.items())} THEN {i + 1}" for i in range(LEVELS)) + " END"
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))))"
    window = " || ' ' || ".join(f"lead(word, {i}) OVER o" for i in range(8))
    return rf"""
    WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t) x),
    wc AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM w GROUP BY 1),
    win AS (SELECT doc_id, pos, {window} AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    twice AS (SELECT doc_id, s FROM win WHERE s IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
    rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM win JOIN twice USING (doc_id, s), range(0, 8) r(k) GROUP BY 1),
    ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
    m AS (SELECT t.doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(t.text) - length(translate(t.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN wc USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
    s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats,
        n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, word_chars * 1000 // greatest(n_words, 1) AS long_words, CASE WHEN n_words > 0 THEN -(word_chars * 1000 // n_words) ELSE -1000000 END AS short_words FROM m),
    f AS (SELECT *, {reached} AS reached FROM s),
    t1 AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
    g AS (SELECT lang, reached, good FROM f JOIN t1 USING (doc_id) WHERE lang IS NOT NULL AND NOT base_failed),
    z AS (SELECT lang, CAST(count_if(good) AS BIGINT) AS n FROM g GROUP BY 1 HAVING count_if(good) > 0),
    c AS (SELECT g.lang, z.n, level, CAST(count_if(good AND reached <= level) AS BIGINT) AS k, count_if(NOT good AND reached <= level) AS bad FROM g JOIN z ON z.lang = g.lang, range(1, {LEVELS + 1}) r(level) GROUP BY 1, 2, 3),
    p AS (SELECT lang, min(level) AS level FROM (SELECT *, max(bad) OVER (PARTITION BY lang) AS most FROM (SELECT *, CASE WHEN k >= n * {ALPHA} THEN 1 ELSE {tail} END AS p FROM c) x WHERE p <= {DELTA} * n / (SELECT sum(n) FROM z)) y WHERE bad >= {ENOUGH} * most GROUP BY 1)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(reached <= level, false) AS kept FROM f LEFT JOIN p ON p.lang = f.lang
    """


#: All pairs that share a shingle, the exact test, and reachability over the links.
_JACCARD = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
    sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 3 THEN list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
    c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * s >= 90 * (ca.n + cb.n - s)),
    u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.m)
    SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN c USING (doc_id) GROUP BY 1
"""

ORACLES = {"op7_jaccard_join": _JACCARD, "op6_quality_rules": _quality()}
