"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"

# Metrics that the threshold table names, as SQL over the counts below.
_METRIC = {
    "mean_word_chars": "word_chars / nullif(n_words, 0)",
    "symbol_ratio": "n_symbols / nullif(n_words, 0)",
    "stop_ratio": "n_stop / nullif(n_words, 0)",
    "capital_ratio": "n_capitals / nullif(n_words, 0)",
    "stutter_ratio": "n_stutters / nullif(n_words, 0)",
    "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
}


def _op5() -> str:
    good = []
    for r in RULES:
        value = f"coalesce({_METRIC[r.metric]}, 0.0)"
        if r.low is not None:
            good.append(f"{value} >= {r.low}")
        if r.high is not None:
            good.append(f"{value} <= {r.high}")
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(regexp_extract_all(text, '{_WORD}')) AS w,
             generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS p FROM t),
wc AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars,
              count(*) FILTER (lower(w) IN ({stops})) AS n_stop,
              count(*) FILTER (w = upper(w) AND w <> lower(w)) AS n_capitals,
              count(*) FILTER (w = nxt) AS n_stutters
       FROM (SELECT *, lead(w) OVER (PARTITION BY k ORDER BY p) AS nxt FROM w) GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS l FROM t),
lc AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
       FROM l WHERE regexp_matches(l, '{_WORD}') GROUP BY k),
v AS (SELECT k, p, count(*) OVER f AS n, string_agg(w, ' ') OVER f AS win FROM w
      WINDOW f AS (PARTITION BY k ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, win) AS c
                        FROM v WHERE n = 8) WHERE c > 1),
rc AS (SELECT k, count(DISTINCT q) AS n_repeat_words
       FROM (SELECT k, unnest(range(p, p + 8)) AS q FROM r) GROUP BY k),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, n_stop, n_capitals, n_stutters
      FROM t LEFT JOIN wc USING (k) LEFT JOIN lc USING (k) LEFT JOIN rc USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND {' AND '.join(good)} AS kept
FROM m"""


# Rows that agree in id, label and vector are one row; all vectors are of one length.
_OP12 = """
WITH e AS (SELECT DISTINCT vec_id,
                  CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  embedding, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
             list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0
       AND NOT (a.vec_id = b.vec_id AND a.label = b.label AND a.embedding = b.embedding)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

ORACLE = {"op5_quality_rules": _op5(), "op12_hard_negatives": _OP12}
