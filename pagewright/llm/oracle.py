"""DuckDB counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

import math

from pagewright.llm.line_dedup import OP6_SQL
from pagewright.llm.quality import AdaptiveRules
from pagewright.llm.resampling import OP11_SQL
from pagewright.llm.search import OP13_SQL
from pagewright.llm.suffix_dedup import OP8_SQL
from pagewright.llm.warc import OP12_SQL

_W = r"[^\x20\x09-\x0D]+"
_S = r"[\x20\x09-\x0D]"

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.c)
SELECT d AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id, min(c) = d AS kept FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""


def op5_sql(rules: AdaptiveRules | None = None) -> str:
    rules = rules or AdaptiveRules()
    base = (1 + rules.alpha) / (1 - rules.alpha)
    value = {m: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END" for m, (a, b, *_) in rules.metrics.items()}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {v} AS v FROM c WHERE NOT base_failed" + f" AND {v} > 0" * rules.metrics[m][2] for m, v in value.items())
    at = lambda q: f"min(bucket) FILTER (upto >= {q}::DOUBLE * n_rows)"
    read = lambda b: f"CASE WHEN {b} = -1000000 THEN 0 ELSE 2 * pow({base!r}::DOUBLE, {b}) / {base + 1!r}::DOUBLE END"

    def level(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        return f"""{name}0 AS (SELECT {keys}metric, bucket, sum(n) AS n FROM sk GROUP BY ALL),
{name}1 AS (SELECT *, sum(n) OVER (PARTITION BY {keys}metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}metric) AS n_rows FROM {name}0),
{name} AS (SELECT {keys}metric, any_value(n_rows) AS n_rows, {read(at(0.25))} AS q1, {read(at(0.75))} AS q3 FROM {name}1 GROUP BY {keys}metric)"""

    pick = lambda q: f"CASE WHEN f.n_rows >= {rules.support} THEN f.{q} WHEN m.n_rows >= {rules.support} THEN m.{q} ELSE t.{q} END"
    fence = lambda m: f"(SELECT fence FROM fe WHERE fe.lang IS NOT DISTINCT FROM c.lang AND fe.source IS NOT DISTINCT FROM c.source AND fe.metric = '{m}')"
    failed = "list_filter([" + ", ".join(f"CASE WHEN {a} > {fence(m)} * {b} + {few} THEN '{m}' END" for m, (a, b, _, few) in rules.metrics.items()) + "], lambda x: x IS NOT NULL)"
    metrics = ", ".join(f"('{m}')" for m in rules.metrics)
    count = lambda cls: f"(length(t) - length(regexp_replace(t, '{cls}', '', 'g')))::BIGINT"
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d CROSS JOIN (VALUES (0), (1), (2)) o(j) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_S}', '', 'g'))::BIGINT AS word_chars, {count('[#*$%&|<>]')} AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(w) < {rules.min_words} OR 100 * coalesce(rep.n, 0) > {rules.max_repeat_percent} * len(w) AS base_failed, len(lines)::BIGINT AS n_lines, {count('[A-Z]')} AS n_upper, {count('!')} AS n_bang
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
x AS ({rows}),
sk AS (SELECT lang, source, metric, CASE WHEN v > 0 THEN ceil(ln(v) / {math.log(base)!r}::DOUBLE)::INT ELSE -1000000 END AS bucket, count(*) AS n FROM x GROUP BY ALL),
{level("f", "lang, source")},
{level("m", "lang")},
{level("t", "")},
gr AS (SELECT * FROM (SELECT DISTINCT lang, source FROM c) CROSS JOIN (VALUES {metrics}) v(metric)),
fe AS (SELECT gr.lang, gr.source, gr.metric, ({pick('q3')}) + {rules.spread!r}::DOUBLE * (({pick('q3')}) - ({pick('q1')})) AS fence
  FROM gr LEFT JOIN f ON gr.lang IS NOT DISTINCT FROM f.lang AND gr.source IS NOT DISTINCT FROM f.source AND gr.metric = f.metric
  LEFT JOIN m ON gr.lang IS NOT DISTINCT FROM m.lang AND gr.metric = m.metric LEFT JOIN t ON gr.metric = t.metric),
v AS (SELECT *, {failed} AS failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_metrics FROM v
"""


def oracle_queries() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op5_quality_rules": op5_sql(), "op6_line_dedup": OP6_SQL, "op8_suffix_array_dedup": OP8_SQL, "op11_importance_resampling": OP11_SQL, "op12_warc": OP12_SQL, "op13_ranked_search": OP13_SQL}
