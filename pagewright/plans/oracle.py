"""DuckDB counterparts of the audit queries: the same rules in SQL over the pages table."""

from __future__ import annotations

from pagewright.functions.text import WS_CHARS
from pagewright.operators.checks import CHECKS, check_id, check_rows
from pagewright.operators.rules import GENERIC_ANCHORS, GENERIC_HEADINGS, PATH_TYPES, STRATEGIC

WS = f"[{WS_CHARS}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _decode(x: str) -> str:
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = f"replace({x}, {_q(name)}, {_q(char)})"
    return x


def _strip(x: str) -> str:
    return f"trim(regexp_replace({_decode(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")}, {_q(WS + '+')}, ' ', 'g'))"


def _visible(x: str) -> str:
    for tag in ("script", "style", "noscript", "template"):
        x = f"regexp_replace({x}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    return _strip(x)


def _attr(x: str, name: str) -> str:
    raw = f"regexp_extract({x}, {_q(rf'''(?i){WS}{name}{WS}*={WS}*("[^"]*"|'[^']*'|[^{WS_CHARS}>]+)''')}, 1)"
    return f"nullif(trim({_decode(f"regexp_replace({raw}, {_q('''^["']|["']$''')}, '', 'g')")}), '')"


HEADINGS = "(?is)" + "|".join(f"<h{n}\\b[^>]*>.*?</h{n}>" for n in range(1, 7))
CHROME = "(?is)" + "|".join(f"<{t}\\b[^>]*>.*?</{t}>" for t in ("nav", "header", "footer"))
LISTS = "(?is)<ul\\b[^>]*>.*?</ul>|<ol\\b[^>]*>.*?</ol>"
ANCHOR = "(?is)<a\\b[^>]*>.*?</a>"
INNER = "(?s)^<[^>]*>(.*)</[^<]*$"
BODY = r"(?is)<body\b[^>]*>(.*)</body>"
SENTENCE = f"[.!?]{WS}+[A-ZА-ЯЁ]"
OVERLAY = (
    r"(?i)(cookie|gdpr|consent|interstitial|paywall|subscribe-modal|newsletter-modal)",
    rf"""(?i)position{WS}*:{WS}*fixed|class=["'][^"']*(modal|overlay|interstitial|consent)""",
)


def _anchors(x: str) -> str:
    row = f"{{'href': {_attr("regexp_extract(a, '(?s)^<a([^>]*)>', 1)", 'href')}, 'text': {_strip(f"regexp_extract(a, '{INNER}', 1)")}, 'rel': coalesce({_attr("regexp_extract(a, '(?s)^<a([^>]*)>', 1)", 'rel')}, '')}}"
    return f"list_filter(list_transform(regexp_extract_all({x}, '{ANCHOR}'), lambda a: {row}), lambda r: r.href IS NOT NULL)"


def _sentences(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN 0 ELSE 1 + len(regexp_extract_all({t}, {_q(SENTENCE)})) END::BIGINT"


def _words(t: str) -> str:
    return f"len(regexp_extract_all({t}, {_q(f'[^{WS_CHARS}]+')}))::BIGINT"


_NORMAL = "CASE WHEN regexp_matches(url, '(?i)^https?://[^/?#]') THEN lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) || coalesce(nullif(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1), ''), '/') || regexp_extract(url, '(\\?[^#]*)', 1) ELSE '' END"

#: p: pages with URL parts and body; each later step adds columns.
PAGES = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\\.', '') AS site,
    lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)) AS host,
    coalesce(nullif(regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path,
    {_NORMAL} AS normal,
    substr(sha1(url), 1, 16) AS hash,
    CASE WHEN regexp_matches(coalesce(html, ''), '{BODY}') THEN regexp_extract(html, '{BODY}', 1) ELSE coalesce(html, '') END AS body
  FROM pages)"""

SNAP = PAGES + f""",
h AS (SELECT *, list_filter(list_transform(regexp_extract_all(body, '{HEADINGS}'), lambda x: {{'level': substr(x, 3, 1)::INT, 'text': {_strip(f"regexp_extract(x, '{INNER}', 1)")}}}), lambda r: r.text <> '') AS hs,
    {_visible('body')} AS body_text, {_strip("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")} AS title, {_anchors('body')} AS links FROM p),
s AS (SELECT *, list_transform(list_filter(hs, lambda r: r.level = 1), lambda r: r.text) AS h1, list_transform(list_filter(hs, lambda r: r.level = 2), lambda r: r.text) AS h2, list_transform(list_filter(hs, lambda r: r.level = 3), lambda r: r.text) AS h3,
    length(body_text) AS body_length, length(html) AS html_length, {_sentences('body_text')} AS sentences, {_words('body_text')} AS words,
    len(regexp_extract_all(body, '{LISTS}'))::BIGINT AS list_count, len(regexp_extract_all(body, '(?i)<table\\b'))::BIGINT AS table_count,
    regexp_matches(body, '{OVERLAY[0]}') AND regexp_matches(body, {_q(OVERLAY[1])}) AS interstitial,
    lower(trim(title)) || '|' || lower(trim(coalesce(list_transform(list_filter(hs, lambda r: r.level = 1), lambda r: r.text)[1], ''))) AS sig FROM h),
e AS (SELECT page_id, site, normal, path, unnest(links) AS l, regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) AS origin FROM s),
r AS (SELECT site, page_id, l.href AS href, CASE WHEN l.href LIKE 'http%' THEN l.href WHEN l.href LIKE '/%' THEN lower(origin) || l.href END AS target FROM e),
inbound AS (SELECT site, target, count(*) AS n FROM r WHERE target IS NOT NULL GROUP BY ALL),
lang AS (SELECT site, count(DISTINCT lower(regexp_extract(target, '^https?://[^/]+/+([^/?#]+)', 1))) FILTER (regexp_matches(lower(regexp_extract(target, '^https?://[^/]+/+([^/?#]+)', 1)), '^[a-z]{{2}}(-[a-z]{{2}})?$')) AS languages FROM r GROUP BY site),
ctx AS (SELECT s.*, coalesce(i.n, 0) AS inbound_links, coalesce(g.languages, 0) AS languages, coalesce(g.languages, 0) >= 2 AS multilingual,
    s.sig <> '|' AND d.site IS NOT NULL AS competing
  FROM s LEFT JOIN inbound i ON i.site = s.site AND i.target = s.normal LEFT JOIN lang g ON g.site = s.site
  LEFT JOIN (SELECT site, sig FROM s GROUP BY ALL HAVING min(url) <> max(url)) d ON d.site = s.site AND d.sig = s.sig)"""


def _in(xs: list[str]) -> str:
    return "(" + ", ".join(map(_q, xs)) + ")"


_AVERAGE = "(words::DOUBLE / nullif(sentences, 0))"
_TEXTS = "len(list_filter(links, lambda x: x.text <> ''))"
_GENERIC = f"len(list_filter(links, lambda x: lower(x.text) IN {_in(GENERIC_ANCHORS)}))"
_SUBS = "len(h2 || h3)"
_GENERIC_SUBS = f"len(list_filter(h2 || h3, lambda t: lower(t) IN {_in(GENERIC_HEADINGS)} OR regexp_matches(t, '^[0-9]+$')))"


def _path_type() -> str:
    cases = " ".join(f"WHEN regexp_matches(path, {_q('(?i)' + p.replace('(?![A-Za-z0-9_])', chr(92) + 'b'))}) THEN {_q(n)}" for n, p in PATH_TYPES)
    return f"CASE {cases} ELSE 'other' END"


#: Verdicts on pages that have no images, forms, structured data, meta robots, og: or alternate links, as these have none.
VERDICTS = {
    1: "'PASS'",
    2: "'PASS'",
    3: "CASE WHEN competing THEN 'FAIL' ELSE 'PASS' END",
    4: "CASE WHEN inbound_links > 0 THEN 'PASS' ELSE 'FAIL' END",
    5: "'PASS'",
    6: "'PASS'",
    7: "CASE WHEN len(h1) = 1 THEN 'PASS' ELSE 'FAIL' END",
    8: f"CASE WHEN sentences < 5 THEN 'N/A' WHEN {_AVERAGE} <= 28 THEN 'PASS' WHEN {_AVERAGE} <= 36 THEN 'NEEDS_REVIEW' ELSE 'FAIL' END",
    9: "CASE WHEN list_count > 0 OR table_count > 0 THEN 'PASS' WHEN body_length < 500 THEN 'N/A' ELSE 'NEEDS_REVIEW' END",
    10: f"CASE WHEN regexp_matches(body_text, {_q(f'(?i)Published(?: on)?:?{WS}+[0-9]{{4}}')}) THEN 'PASS' WHEN body_length < 400 THEN 'N/A' ELSE 'NEEDS_REVIEW' END",
    11: f"CASE WHEN regexp_matches(body_text, {_q(f'(?i)(?:Reviewed|Updated)(?: on)?:?{WS}+[0-9]{{4}}')}) THEN 'PASS' WHEN body_length < 400 THEN 'N/A' ELSE 'NEEDS_REVIEW' END",
    12: f"CASE WHEN {_path_type()} NOT IN ('article', 'case', 'event') THEN 'N/A' WHEN regexp_matches(body_text, {_q(f'by{WS}+[A-Z][a-z]+{WS}+[A-Z][a-z]+')}) THEN 'PASS' ELSE 'NEEDS_REVIEW' END",
    13: "CASE WHEN len(h1) = 0 THEN 'FAIL' WHEN body_length > 600 AND len(h2) = 0 THEN 'FAIL' ELSE 'PASS' END",
    14: f"CASE WHEN {_SUBS} = 0 THEN 'N/A' WHEN {_GENERIC_SUBS}::DOUBLE / {_SUBS} >= 0.6::DOUBLE THEN 'FAIL' ELSE 'PASS' END",
    15: "CASE WHEN body_length < 200 AND html_length > 4000 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END",
    16: f"CASE WHEN {_TEXTS} = 0 THEN 'N/A' WHEN {_GENERIC}::DOUBLE / {_TEXTS} >= 0.4::DOUBLE THEN 'FAIL' WHEN {_GENERIC}::DOUBLE / {_TEXTS} >= 0.2::DOUBLE THEN 'NEEDS_REVIEW' ELSE 'PASS' END",
    17: "CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 2 THEN 'N/A' ELSE 'FAIL' END",
    **dict.fromkeys((18, 19, 20, 22, 23, 26, 27, 31), "'N/A'"),
    21: "'FAIL'",
    24: r"CASE WHEN regexp_matches(body_text, '(?i)<video\b|youtube\.com/embed|player\.vimeo\.com/video') THEN 'NEEDS_REVIEW' ELSE 'N/A' END",
    25: "'FAIL'",
    28: "'NEEDS_REVIEW'",
    29: "CASE WHEN html_length > 1500000 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END",
    30: "CASE WHEN interstitial THEN 'NEEDS_REVIEW' ELSE 'PASS' END",
    32: "CASE WHEN html_length > 2000 AND body_length < 200 THEN 'FAIL' ELSE 'PASS' END",
    33: "CASE WHEN regexp_matches(url, '(?i)/(privacy|legal|terms|cookies?)') THEN 'NEEDS_REVIEW' ELSE 'N/A' END",
    34: "CASE WHEN multilingual THEN 'FAIL' ELSE 'N/A' END",
    35: "CASE WHEN len(list_distinct(list_filter([lower(title), lower(coalesce(h1[1], ''))], lambda t: t <> ''))) <= 1 THEN 'PASS' ELSE 'NEEDS_REVIEW' END",
    36: f"CASE WHEN regexp_matches(path, {_q('(?i)' + STRATEGIC + chr(92) + 'b')}) THEN 'NEEDS_REVIEW' ELSE 'N/A' END",
}

_DIM = "dim(check_id, ordinal, title, severity, gap_category, scope, mode, weight, factor, excluded) AS (VALUES " + ", ".join(
    "(" + ", ".join(_q(x) if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in row) + ")" for row in check_rows()
) + ")"

_ROWS = " UNION ALL ".join(f"SELECT page_id, site, url, hash, '{check_id(n)}' AS check_id, {VERDICTS[n]} AS value FROM ctx" for n, *_ in CHECKS)

_REST = "),\n" + _DIM + """,
scores AS (SELECT site, page_id, url, greatest(0, least(100, floor((100 - (sum(CASE WHEN value = 'FAIL' THEN weight ELSE 0 END) + 0.5::DOUBLE * count(*) FILTER (value = 'NEEDS_REVIEW'))) * 100 + 0.5::DOUBLE) / 100))::DOUBLE AS score FROM v JOIN dim USING (check_id) GROUP BY ALL),
sb AS (SELECT *, CASE WHEN score >= 95 THEN 'high' WHEN score >= 90 THEN 'average' WHEN score >= 80 THEN 'low' WHEN score >= 60 THEN 'bad' ELSE 'very_bad' END AS bucket FROM scores),
m AS (SELECT s.site, k.check_id, count(*) FILTER (v.value = 'PASS') AS pass, count(*) FILTER (v.value = 'FAIL') AS fail, count(*) FILTER (v.value = 'N/A') AS na, count(*) FILTER (v.value = 'NEEDS_REVIEW') AS needs_review
  FROM (SELECT DISTINCT site FROM v) s CROSS JOIN dim k LEFT JOIN v ON v.site = s.site AND v.check_id = k.check_id GROUP BY ALL),
mm AS (SELECT check_id, sum(pass)::BIGINT AS pass, sum(fail)::BIGINT AS fail, sum(na)::BIGINT AS na, sum(needs_review)::BIGINT AS needs_review FROM m GROUP BY ALL),
f AS (SELECT m.*, factor, CASE WHEN pass + fail > 0 THEN floor((fail::DOUBLE / (pass + fail)) * 100 + 0.5::DOUBLE) END AS fail_pct FROM m JOIN dim USING (check_id) WHERE NOT excluded),
g AS (SELECT *, coalesce(least(100, greatest(0, floor(fail_pct * factor + 0.5::DOUBLE))), 0)::DOUBLE AS priority FROM f),
pr AS (SELECT *, CASE WHEN priority >= 50 THEN 'HIGH' WHEN priority >= 20 THEN 'MEDIUM' WHEN priority >= 5 THEN 'LOW' ELSE 'NONE' END AS bucket, row_number() OVER (PARTITION BY site ORDER BY priority DESC, coalesce(fail_pct, -1) DESC, check_id) AS rank FROM g),
rates AS (SELECT m.site, check_id, CASE WHEN pass + fail + na + needs_review > 0 THEN fail::DOUBLE / (pass + fail + na + needs_review) ELSE 0 END AS rate, n.pages FROM m JOIN (SELECT site, count(DISTINCT url) AS pages FROM v GROUP BY ALL) n USING (site)),
top AS (SELECT site AS competitor FROM p GROUP BY site ORDER BY count(*) DESC, site LIMIT 2),
cmp AS (SELECT t.site AS target, k.site AS competitor, t.check_id, t.rate AS target_rate, k.rate AS competitor_rate, t.rate - k.rate AS delta, CASE WHEN t.pages < 10 OR k.pages < 10 THEN 'low' ELSE 'normal' END AS confidence
  FROM rates t JOIN top ON t.site <> top.competitor JOIN rates k ON k.site = top.competitor AND k.check_id = t.check_id)"""

V = SNAP + ",\nv AS (" + _ROWS + _REST

#: The same over verdicts after a judgement of every open one: as PASS, as FAIL, as still open, or with an error, by check.
JUDGED_V = SNAP + ",\nv0 AS (" + _ROWS + "),\nv AS (SELECT * REPLACE (CASE WHEN value = 'NEEDS_REVIEW' AND substr(check_id, 2)::INT % 4 = 0 THEN 'PASS' WHEN value = 'NEEDS_REVIEW' AND substr(check_id, 2)::INT % 4 = 1 THEN 'FAIL' ELSE value END AS value) FROM v0" + _REST

_JUDGED = V + """,
o AS (SELECT *, value = 'NEEDS_REVIEW' AS open, value = 'NEEDS_REVIEW' AND page_id % 3 = 0 AS asked, substr(check_id, 2)::INT % 3 AS n FROM v)"""


#: The whole shuffle, swap after swap, over a list of all pages: for small tables.
SAMPLE = """
WITH RECURSIVE l AS (SELECT list(page_id ORDER BY page_id, url) AS ids, count(*) AS n FROM pages),
a AS (SELECT i, n, ((42 + (n - i) * 1831565813::HUGEINT) % 4294967296)::BIGINT AS a FROM l, range(1, 10000000) r(i) WHERE i < n),
t AS (SELECT i, ((xor(a, a >> 15)::HUGEINT * (a | 1)) % 4294967296)::BIGINT AS t FROM a),
u AS (SELECT i, xor(t, ((t + (xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296) % 4294967296)::BIGINT) AS u FROM t),
j AS (SELECT i, floor(xor(u, u >> 14) / 4294967296::DOUBLE * (i + 1))::BIGINT AS j FROM u),
s(i, ids) AS (SELECT n - 1, ids FROM l UNION ALL
  SELECT s.i - 1, CASE WHEN j.j = s.i THEN ids ELSE ids[:j.j] || [ids[s.i + 1]] || ids[j.j + 2:s.i] || [ids[j.j + 1]] || ids[s.i + 2:] END FROM s JOIN j ON j.i = s.i WHERE s.i > 0),
e AS (SELECT ids FROM s WHERE i = 0),
p AS (SELECT unnest(range(least(25, len(ids)))) AS place, unnest(ids[:25]) AS page_id FROM e)
SELECT place::INT AS place, page_id, url FROM p JOIN pages USING (page_id)
"""

CRAWL = SNAP + """,
web AS (SELECT min_by(page_id, page_id) AS page_id, normal FROM p WHERE normal <> '' GROUP BY normal),
seed AS (SELECT site, min_by(normal, page_id) AS url, min_by(host, page_id) AS host FROM p WHERE normal <> '' GROUP BY site),
a AS (SELECT page_id, unnest(links) AS l, unnest(range(len(links))) AS pos, regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) AS origin FROM s),
b AS (SELECT page_id, pos, regexp_replace(CASE WHEN l.href LIKE 'http%' THEN l.href WHEN l.href LIKE '/%' THEN lower(origin) || l.href ELSE '' END, '#.*$', '') AS target FROM a WHERE NOT regexp_matches(lower(coalesce(l.rel, '')), '\\bnofollow\\b')),
edge AS (SELECT web.normal AS url, pos, array_to_string(list_transform(string_split(target, ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), '') AS target, lower(regexp_extract(target, '(?i)^https?://([^/?#:]+)', 1)) AS host FROM b JOIN web USING (page_id) WHERE target <> ''),
g0 AS (SELECT site, url, 0 AS depth, 0 AS k FROM seed),
o1 AS (SELECT g0.site, edge.target AS url, min((k, pos)) AS o FROM g0 JOIN seed USING (site) JOIN edge ON edge.url = g0.url AND edge.host = seed.host WHERE (g0.site, edge.target) NOT IN (SELECT (site, url) FROM g0) GROUP BY ALL),
g1 AS (SELECT site, url, 1 AS depth, row_number() OVER (PARTITION BY site ORDER BY o) AS k FROM o1),
o2 AS (SELECT g1.site, edge.target AS url, min((k, pos)) AS o FROM g1 JOIN seed USING (site) JOIN edge ON edge.url = g1.url AND edge.host = seed.host WHERE (g1.site, edge.target) NOT IN (SELECT (site, url) FROM g0 UNION ALL SELECT (site, url) FROM g1) GROUP BY ALL),
g2 AS (SELECT site, url, 2 AS depth, row_number() OVER (PARTITION BY site ORDER BY o) AS k FROM o2),
g AS (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2)"""


def oracle_queries() -> dict[str, str]:
    page = lambda x: f"{PAGES} SELECT page_id, {x} FROM p"
    snap = lambda x: f"{SNAP} SELECT {x}"
    v = lambda x: f"{V} SELECT {x}"
    out = {
        "priority": v("site, check_id, fail_pct, priority, bucket, rank FROM pr"),
        "checklist": "WITH " + _DIM + " SELECT check_id, severity, gap_category, scope, weight, factor, excluded FROM dim",
        "body_only": page("body"),
        "strip_tags": page(f"{_strip('html')} AS text"),
        "visible_text": page(f"{_visible('body')} AS text"),
        "page_title": snap("page_id, title FROM s"),
        "page_lang": page(f"lower(coalesce({_attr("regexp_extract(html, '(?i)<html([^>]*)>', 1)", 'lang')}, '')) AS lang"),
        "headings": snap("page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, x.level AS level, x.text AS text FROM (SELECT page_id, unnest(hs) AS x, unnest(range(len(hs))) AS i FROM s)"),
        "links": snap("page_id, i::INT AS pos, x.href AS href, x.text AS text, x.rel AS rel FROM (SELECT page_id, unnest(links) AS x, unnest(range(len(links))) AS i FROM s)"),
        "links_in_chrome": snap(f"page_id, (len(links) - o)::BIGINT AS in_chrome, o::BIGINT AS outside FROM (SELECT page_id, links, len({_anchors(f"regexp_replace(body, '{CHROME}', ' ', 'g')")}) AS o FROM s)"),
        "list_count": snap("page_id, list_count AS n FROM s"),
        "table_count": snap("page_id, table_count AS n FROM s"),
        "sentence_stats": snap("page_id, sentences, words, CASE WHEN sentences > 0 THEN words::DOUBLE / sentences ELSE 0 END AS average_words FROM s"),
        "sentence_stats_documents": f"WITH t AS (SELECT doc_id, trim(regexp_replace(text, {_q(WS + '+')}, ' ', 'g')) AS t FROM documents), n AS (SELECT doc_id, {_sentences('t')} AS sentences, {_words('t')} AS words FROM t) SELECT doc_id, sentences, words, CASE WHEN sentences > 0 THEN words::DOUBLE / sentences ELSE 0 END AS average_words FROM n",
        "interstitial": snap("page_id, interstitial AS candidate FROM s"),
        "decode_entities": page(f"{_decode('html')} AS text"),
        "url_hash": page("hash"),
        "url_depth": page("len(list_filter(string_split(path, '/'), lambda x: x <> ''))::BIGINT AS depth"),
        "url_filename": page("string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS filename"),
        "normalize_url": page("normal"),
        "site_of_page": page("site"),
        "page_type": page(f"{_path_type()} AS type"),
        "www_alias": page("TRUE AS is_alias, FALSE AS self_alias, host || ',' || CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE 'www.' || host END AS aliases"),
        "host_filter": PAGES + " SELECT page_id, url FROM p WHERE host IN (SELECT host FROM p ORDER BY page_id LIMIT 5)",
        "sample_pages": "SELECT page_id, url FROM pages ORDER BY sha1(coalesce(url, '') || '42'), page_id LIMIT 25",
        "select_urls": PAGES + " SELECT page_id, url FROM p WHERE normal IN (SELECT normal FROM p WHERE page_id % 7 = 0)",
        "inbound_links": snap("page_id, inbound_links::BIGINT AS inbound_links FROM ctx"),
        "link_targets": snap("site, href, count(*) AS n FROM r GROUP BY ALL"),
        "sitemap_membership": PAGES + " SELECT page_id, (site, normal) IN (SELECT (site, normal) FROM p WHERE page_id % 3 = 0) AS in_sitemap FROM p",
        "duplicate_intent": snap("page_id, competing FROM ctx"),
        "site_multilingual": snap("DISTINCT site, languages::BIGINT AS languages, multilingual FROM ctx"),
        "dedupe_canonical": PAGES + " SELECT normal AS canonical_key, min(page_id) AS page_id, count(*) AS copies FROM p WHERE normal <> '' GROUP BY ALL",
        "page_snapshot": snap(f"page_id, title, lower(coalesce({_attr("regexp_extract(html, '(?i)<html([^>]*)>', 1)", 'lang')}, '')) AS lang, '' AS meta_robots, '' AS canonical, len(h1)::BIGINT AS h1s, len(links)::BIGINT AS links, 0::BIGINT AS images, list_count, table_count, body_length, html_length, sentences AS sentence_count, CASE WHEN sentences > 0 THEN words::DOUBLE / sentences ELSE 0 END AS average_sentence_words, interstitial FROM s"),
        **{f"check_{n:03d}": snap(f"page_id, {VERDICTS[n]} AS value FROM ctx") for n, *_ in CHECKS},
        "polite_fetch": PAGES + " SELECT url, 200 AS status, TRUE AS ok, FALSE AS redirected, length(min_by(html, page_id))::BIGINT AS body_length, ((row_number() OVER (PARTITION BY host ORDER BY sha1(url)) - 1) * 250)::BIGINT AS asked_ms FROM p GROUP BY url, host",
        "streamed_site_checks": v("page_id, check_id, value FROM v WHERE check_id IN ('C003', 'C004', 'C034')"),
        "first_seen_log": PAGES + ", d AS (SELECT site, url, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM p), k AS (SELECT DISTINCT site, url, CASE WHEN depth <= 1 THEN 1 WHEN depth = 2 THEN 2 ELSE 3 END AS k FROM d) SELECT site, url, 'run' || k AS first_seen, (200 + k)::INT AS first_status FROM k",
        "latest_run": PAGES + " SELECT site, max(strftime(to_timestamp(1704067200 + page_id * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H-%M-%S-000Z')) AS run_id, count(DISTINCT page_id)::BIGINT AS runs FROM p GROUP BY site",
        "duplicate_examples": SNAP + ", q AS (SELECT site, sig, page_id, url FROM s WHERE sig <> '|') SELECT a.page_id, count(*)::BIGINT AS others, array_to_string((list(b.url ORDER BY b.page_id))[:3], ' ') AS examples FROM q a JOIN q b ON a.site = b.site AND a.sig = b.sig AND a.url <> b.url GROUP BY a.page_id",
        "page_ordinals": "SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS ordinal FROM pages",
        "seeded_sample": SAMPLE,
        "streamed_crawl": CRAWL + " SELECT site, url, depth, row_number() OVER (PARTITION BY site ORDER BY depth, k) - 1 AS ordinal, CASE WHEN url IN (SELECT normal FROM web) THEN 200 ELSE 404 END AS status FROM g",
        "verdicts": v("page_id, check_id, value FROM v"),
        "review_queue": v("page_id, hash, check_id, severity, CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END AS severity_rank FROM v JOIN dim USING (check_id) WHERE value = 'NEEDS_REVIEW'"),
        "check_matrix": v("* FROM m"),
        "page_scores": v("page_id, score, bucket FROM sb"),
        "bucket_counts": v("s.site, b.bucket, count(sb.page_id) AS pages FROM (SELECT DISTINCT site FROM p) s CROSS JOIN (VALUES ('high'), ('average'), ('low'), ('bad'), ('very_bad')) b(bucket) LEFT JOIN sb ON sb.site = s.site AND sb.bucket = b.bucket GROUP BY ALL"),
        "site_summary": v("site, count(*) AS pages, floor(avg(score) * 100 + 0.5::DOUBLE) / 100 AS average_score, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in ("high", "average", "low", "bad", "very_bad")) + " FROM sb GROUP BY site"),
        "top_issues": v("check_id, fail, needs_review FROM mm WHERE fail > 0 OR needs_review > 0 ORDER BY fail DESC, check_id LIMIT 5"),
        "coverage": v("sb.site, count(*) AS pages_analyzed, count(*) AS total_urls, any_value(r.n) AS residual_review, FALSE AS thorough FROM sb JOIN (SELECT site, count(*) FILTER (value = 'NEEDS_REVIEW') AS n FROM v GROUP BY ALL) r USING (site) GROUP BY sb.site"),
        "priority_bucket_counts": v("s.site, b.bucket, count(pr.check_id) AS checks FROM (SELECT DISTINCT site FROM p) s CROSS JOIN (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('NONE')) b(bucket) LEFT JOIN pr ON pr.site = s.site AND pr.bucket = b.bucket GROUP BY ALL"),
        "priority_dividers": v("site, check_id, rank, coalesce(lag(bucket) OVER (PARTITION BY site ORDER BY rank) <> bucket, TRUE) AS starts_bucket FROM pr"),
        "priority_cells": v("site, check_id, CASE WHEN fail_pct IS NULL THEN 'not measured' WHEN fail_pct < 5 THEN 'rarely fails' ELSE 'fails on pages' END AS why, CASE WHEN fail_pct >= 60 THEN 'high' WHEN fail_pct >= 25 THEN 'mid' ELSE 'low' END AS pct_class FROM pr"),
        "report_top_areas": v("check_id, severity, gap_category, CASE WHEN pass + fail + needs_review > 0 THEN fail::DOUBLE / (pass + fail + needs_review) ELSE 0 END AS fail_rate, fail FROM mm JOIN dim USING (check_id) WHERE fail > 0 OR needs_review > 0 ORDER BY fail_rate DESC, fail DESC, check_id LIMIT 15"),
        "compare_checks": v("* FROM cmp"),
        "compare_worse": v("* FROM cmp WHERE delta >= 0.1::DOUBLE"),
        "compare_better": v("* FROM cmp WHERE delta <= -0.1::DOUBLE"),
        "compare_warnings": v("DISTINCT target, competitor FROM cmp WHERE confidence = 'low'"),
        "rescored_matrix": JUDGED_V + " SELECT * FROM m",
        "rescored_scores": JUDGED_V + " SELECT page_id, score, bucket FROM sb",
        "rescored_priority": JUDGED_V + " SELECT site, check_id, fail_pct, priority, bucket, rank FROM pr",
        "verdict_deltas": JUDGED_V + " SELECT page_id, check_id, value, sign FROM (SELECT n.page_id, n.check_id, unnest([o.value, n.value]) AS value, unnest([-1, 1]) AS sign FROM v n JOIN v0 o ON o.page_id = n.page_id AND o.check_id = n.check_id AND o.value <> n.value)",
        "url_tree_merge": PAGES + ", t AS (SELECT DISTINCT site, url FROM p WHERE page_id % 2 = 0) SELECT site, url, 'run1' AS first_seen, 200 AS first_status FROM t UNION ALL SELECT DISTINCT site, url, 'run2', 404 FROM p WHERE (site, url) NOT IN (SELECT (site, url) FROM t)",
        "apply_judgements": _JUDGED + """ SELECT page_id, check_id, CASE WHEN asked AND n = 0 THEN 'PASS' ELSE value END AS value, CASE WHEN open AND NOT (asked AND n = 2) THEN 'judge' END AS judged_by, CASE WHEN asked AND n = 0 THEN 0.9::DOUBLE END AS confidence,
          CASE WHEN asked AND n = 2 THEN 'failed' WHEN asked AND n = 0 THEN 'judged' WHEN open THEN 'unchanged' END AS outcome, CASE WHEN asked AND n = 2 THEN 'judge failed: no answer' WHEN asked THEN 'judged' WHEN open THEN 'seen (judge inconclusive)' ELSE 'seen' END AS evidence FROM o""",
        "judge_tallies": _JUDGED + " SELECT count(*) FILTER (asked AND n = 0) AS judged, count(*) FILTER (asked AND n = 2) AS failed, count(*) FILTER (open AND NOT (asked AND n IN (0, 2))) AS unchanged, count(*) FILTER (open AND NOT (asked AND n = 0)) AS residual FROM o",
    }
    return out
