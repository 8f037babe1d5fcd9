"""The quality rules once more as SQL for DuckDB, from the words up."""

from __future__ import annotations

import math

from quirewise.llm.quality import GAMMA, MEASURES, ZERO

_RATES = {
    "word_length": "word_chars / n_words",
    "symbol_rate": "n_symbols / n_words",
    "caps_rate": "n_caps / n_words",
    "dup_line_rate": "n_dup_lines / n_lines",
    "repeat_rate": "n_repeat_words / n_words",
}


def _quartile(measure: str, q: float) -> str:
    reached = f"min(bucket) FILTER (measure = '{measure}' AND up_to > {q} * (total - 1))"
    return f"CASE WHEN {reached} = {ZERO} THEN 0.0 ELSE pow({GAMMA!r}, {reached}::DOUBLE) * {2 / (1 + GAMMA)!r} END"


def _fences(name: str, keys: str, width: float) -> str:
    """Common table of limits by ``keys``; the keys are ``lang, source``, ``lang`` or a constant."""
    quartiles = ", ".join(f"{_quartile(m, q)} AS {m}_{k}" for m in MEASURES for k, q in (("a", 0.25), ("b", 0.75)))
    sides = ", ".join(
        (f"{m}_a - {width} * greatest({m}_b - {m}_a, {least})" if kind == "both" else "0.0")
        + f" AS {m}_low, {m}_b + {width} * greatest({m}_b - {m}_a, {least}) AS {m}_high"
        for m, (least, kind) in MEASURES.items()
    )
    return f"""{name} AS (SELECT {keys}, rows_, {sides} FROM (
  SELECT {keys}, max(total) AS rows_, {quartiles} FROM (
    SELECT *, sum(n) OVER (PARTITION BY {keys}, measure ORDER BY bucket) AS up_to,
      sum(n) OVER (PARTITION BY {keys}, measure) AS total
    FROM (SELECT {keys}, measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys}))"""


def quality_sql(min_rows: int = 200, width: float = 4.0) -> str:
    stacked = " UNION ALL ".join(
        f"SELECT lang, source, 1 AS one, '{m}' AS measure, CASE WHEN {m} > 0 THEN ceil(ln({m}) / {math.log(GAMMA)!r}) ELSE {ZERO} END::BIGINT AS bucket FROM rated WHERE n_words > 0"
        for m in MEASURES
    )

    def limit(measure: str, side: str) -> str:
        column = f"{measure}_{side}"
        return f"CASE WHEN o.rows_ >= {min_rows} THEN o.{column} WHEN l.rows_ >= {min_rows} THEN l.{column} ELSE e.{column} END"

    usual = " AND ".join(f"r.{m} BETWEEN {limit(m, 'low')} AND {limit(m, 'high')}" for m in MEASURES)
    rates = ", ".join(f"CASE WHEN {r.split(' / ')[1]} > 0 THEN {r.replace(' / ', '::DOUBLE / ')} ELSE 0.0 END AS {m}" for m, r in _RATES.items())
    return rf"""WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source, coalesce(text, '') AS t
  FROM documents),
words AS (
  SELECT r, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i
  FROM (SELECT r, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM base)),
totals AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
runs AS (SELECT r, i, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM words),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM runs WHERE len(g) = 8) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY r),
counted AS (
  SELECT r, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(t, '[A-Z]{{2,}}'))::BIGINT AS n_caps
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM base)
    LEFT JOIN totals USING (r) LEFT JOIN covered USING (r)),
rated AS (SELECT *, {rates} FROM counted),
sketch AS (SELECT lang, source, one, measure, bucket, count(*) AS n FROM ({stacked}) GROUP BY ALL),
{_fences("own", "lang, source", width)},
{_fences("by_lang", "lang", width)},
{_fences("every", "one", width)},
judged AS (
  SELECT r.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce({usual}, false) AS usual
  FROM rated r LEFT JOIN own o USING (lang, source) LEFT JOIN by_lang l USING (lang) LEFT JOIN every e ON e.one = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND usual AS kept FROM judged"""
