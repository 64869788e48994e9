"""DuckDB SQL that must give the rows of the registered queries."""

from __future__ import annotations

from .common import WORD
from .fingerprints import ANCHORS

#: Sizes, sources' targets by the fixed point of shared excess, then nested thresholds over the documents in hash order.
OP3_MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (ARRAY[5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size * 3.0::DOUBLE) OVER before, 0.0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, cap / weight) FILTER (WHERE cap >= level * weight) AS level FROM leveled),
plan AS (
  SELECT source, source_size, least(cap, coalesce(chosen.level * weight, cap)) AS target FROM leveled, chosen),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan),
base AS (
  SELECT s.doc_id, s.source, s.size, s.h, b.source_size, b.target, b.whole,
         CAST(floor(b.target - b.whole * b.source_size) AS BIGINT) AS budget
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
r0 AS (SELECT doc_id, source, size, h, source_size, target, whole, 0 AS extra, budget AS rest FROM base),
{{rounds}}
SELECT doc_id, source, size, source_size, target, whole + extra AS copies, (whole + extra) * size AS taken FROM r{{last}}
"""

_ROUND = """
c{k} AS (SELECT *, extra = 0 AND size > 0 AND size <= rest AS can FROM r{p}),
w{k} AS (SELECT *, can AND sum(CASE WHEN can THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= rest AS take FROM c{k}),
r{k} AS (
  SELECT doc_id, source, size, h, source_size, target, whole, CASE WHEN take THEN 1 ELSE extra END AS extra,
         rest - coalesce(sum(CASE WHEN take THEN size END) OVER (PARTITION BY source), 0) AS rest
  FROM w{k})"""


def _mixing(rounds: int = 4) -> str:
    parts = ",".join(_ROUND.format(k=k + 1, p=k) for k in range(rounds))
    return OP3_MIXING.replace("{rounds}", parts).replace("{last}", str(rounds)).replace("{{", "{").replace("}}", "}")


_ANCHOR_LIST = ", ".join(f"'{a}'" for a in dict.fromkeys(ANCHORS))

OP6_FINGERPRINTS = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
nexts AS (
  SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt,
         coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM texts WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, t)),
edited AS (SELECT *, substr(t, 1, n - n // 3) || substr(nt, 1, n // 3) AS e FROM nexts),
both_texts AS (SELECT doc_id, 0 AS kind, t AS x FROM edited UNION ALL SELECT doc_id, 1 AS kind, e AS x FROM edited),
split AS (SELECT doc_id, kind, string_split_regex(lower(x), '[^\p{{L}}\p{{N}}]+') AS w FROM both_texts),
content AS (
  SELECT doc_id, kind, list_filter(
    list_transform(list_zip(w, list_prepend(NULL, w)[:len(w)]), lambda z: {{'v': z[1], 'spot': coalesce(z[2] IN ({_ANCHOR_LIST}), false)}}),
    lambda s: s.v <> '' AND s.v NOT IN ({_ANCHOR_LIST})) AS c
  FROM split),
spotted AS (SELECT doc_id, kind, c, list_transform(c, lambda s: s.v) AS v, len(list_filter(c, lambda s: s.spot)) > 0 AS any_spot FROM content),
signed AS (
  SELECT doc_id, kind, list_sort(list_distinct(list_transform(
    list_filter(list_zip(c, v[2:], v[3:]), lambda z: z[1] IS NOT NULL AND (z[1].spot OR NOT any_spot)),
    lambda z: substr(md5(concat_ws(' ', z[1].v, z[2], z[3])), 1, 8)))) AS sigs
  FROM spotted)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.e) AS edited_sha256,
       coalesce(array_to_string(a.sigs, ''), '') AS fingerprint, coalesce(array_to_string(b.sigs, ''), '') AS edited_fingerprint,
       CASE WHEN len(a.sigs) + len(b.sigs) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(a.sigs, b.sigs))::DOUBLE / (len(a.sigs) + len(b.sigs) - len(list_intersect(a.sigs, b.sigs))) END AS near_edited,
       CASE WHEN len(a.sigs) + len(c.sigs) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(a.sigs, c.sigs))::DOUBLE / (len(a.sigs) + len(c.sigs) - len(list_intersect(a.sigs, c.sigs))) END AS near_next
FROM edited e
JOIN signed a ON a.doc_id = e.doc_id AND a.kind = 0
JOIN signed b ON b.doc_id = e.doc_id AND b.kind = 1
JOIN signed c ON c.doc_id = e.next_id AND c.kind = 0
"""


_HOST = r"regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '\.+$', '')"


def _digit(x: str, k: int) -> str:
    return f"CAST('0x' || substr(md5({x}), {k}, 2) AS INTEGER)"


_DAY = "CAST(DATE '2023-01-01' + CAST({} AS INTEGER) AS TIMESTAMP)".format

OP7_URLFILTER = rf"""
WITH captures AS (
  SELECT page_id, url, {_DAY("(page_id * 37) % 730")} AS fetched_at, {_HOST} AS host FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
log AS (
  SELECT 'host' AS kind, host AS pattern, (ARRAY['spam', 'malware', 'adult'])[{_digit("host", 9)} % 3 + 1] AS category, unnest([
    {{'day': {_DAY(_digit("host", 3))}, 'action': 'add'}},
    {{'day': {_DAY(_digit("host", 3) + " + " + _digit("host", 5) + " + 1")}, 'action': CASE WHEN {_digit("host", 5)} < 128 THEN 'remove' ELSE 'add' END}},
    {{'day': {_DAY(_digit("host", 3) + " + " + _digit("host", 5) + " + " + _digit("host", 7) + " + 2")}, 'action': CASE WHEN {_digit("host", 7)} < 64 THEN 'add' ELSE 'remove' END}}]) AS e
  FROM hosts WHERE {_digit("host", 1)} < 128
  UNION ALL
  SELECT 'domain', pattern, 'season', unnest([
    {{'day': {_DAY("length(pattern) * 10")}, 'action': 'add'}}, {{'day': {_DAY("length(pattern) * 10 + 60")}, 'action': 'remove'}}])
  FROM (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS pattern FROM hosts)
  UNION ALL
  SELECT 'prefix', pattern, 'section', {{'day': {_DAY(_digit("pattern", 3))}, 'action': 'add'}}
  FROM (SELECT DISTINCT host || regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^/?#]*/)', 1) AS pattern FROM captures
        WHERE regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^/?#]*/)', 1) <> '')
  WHERE {_digit("pattern", 1)} < 32),
states AS (SELECT kind, pattern, category, e.day AS day, bool_or(e.action = 'add') AS on_then FROM log GROUP BY ALL),
turns AS (
  SELECT * FROM (SELECT *, lag(on_then) OVER (PARTITION BY kind, pattern, category ORDER BY day) AS was FROM states)
  WHERE coalesce(was, false) <> on_then),
periods AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY kind, pattern, category ORDER BY day) AS until FROM turns) WHERE on_then),
met AS (
  SELECT c.page_id, p.kind, p.pattern, p.category
  FROM captures c JOIN periods p ON p.day <= c.fetched_at AND (p.until IS NULL OR c.fetched_at < p.until) AND (
    (p.kind = 'host' AND c.host = p.pattern)
    OR (p.kind = 'domain' AND (c.host = p.pattern OR ends_with(c.host, '.' || p.pattern)))
    OR (p.kind = 'prefix' AND starts_with(c.host || regexp_extract(c.url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), p.pattern)))),
best AS (
  SELECT page_id, count(*) AS n_active, min({{'n': -length(pattern), 'kind': kind, 'pattern': pattern, 'category': category}}) AS b
  FROM met GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, c.host, best.page_id IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active,
       b.kind || ':' || b.pattern AS entry, b.category AS category
FROM captures c LEFT JOIN best ON c.page_id = best.page_id
"""


OP4_WARC = """
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS p, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
firsts AS (SELECT p, max(page_id) AS first_id FROM payloads WHERE n >= 1000 GROUP BY p)
SELECT a.page_id, CAST(a.n AS BIGINT) AS payload_bytes, sha1(a.p) AS payload_digest,
       CASE WHEN coalesce(f.first_id, a.page_id) = a.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> a.page_id THEN f.first_id END AS refers_to, a.url
FROM payloads a LEFT JOIN firsts f ON a.n >= 1000 AND a.p = f.p
"""

#: All pairs that share a shingle, confirmed on whole sets, then everything that is reachable.
OP8_MINHASH = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM split),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS i
  FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * i >= 75 * (n + m - i)),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.y AS other FROM reached r JOIN links l ON l.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, l.component_id = s.doc_id AS kept
FROM sets s JOIN least l ON l.doc_id = s.doc_id
"""



#: Flags of every document, all orders as lists of filters, and what each step does.
OP11_FILTER_AUDIT = rf"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
failing AS (
  SELECT doc_id, part, list_filter([
    CASE WHEN len(w) < 100 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM split),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT array_to_string(o, '') AS filter_order, k AS step, o[k] AS own, o[:k - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
met AS (
  SELECT part, filter_order, step, own, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_contains(fails, own) AS failed,
         NOT list_has_any(fails, before) AS passed, fails = [own] AS only_this
  FROM failing LEFT JOIN known ON failing.doc_id = known.doc_id, steps),
counts AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, count(*) FILTER (passed AND NOT failed) AS kept, count(*) FILTER (passed AND failed) AS removed,
         count(*) FILTER (failed AND NOT passed) AS redundant, count(*) FILTER (only_this) AS unique_fails,
         count(*) FILTER (passed AND failed AND good) AS good_lost, count(*) FILTER (passed AND failed AND toxic) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts
"""


def _centroids(rounds: int = 5, count: int = 40, width: int = 64) -> str:
    """Every vector against every centroid, round by round."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {count}))""",
    ]
    near = """a{r} AS MATERIALIZED (
  SELECT vec_id, v, min(d) AS b FROM (
    SELECT vec_id, x.v AS v, {{'d': CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'k': c.k}} AS d
    FROM kept x, c{r} c) GROUP BY vec_id, v)"""
    moved = """c{n} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT b.k AS k, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY k, i) GROUP BY k) m
  ON m.k = c.k)"""
    for r in range(rounds + 1):
        parts.append(near.format(r=r))
        if r < rounds:
            parts.append(moved.format(r=r, n=r + 1))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.k = b.k"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_WARC, "op8_minhash": OP8_MINHASH, "op3_mixing": _mixing(), "op6_fingerprints": OP6_FINGERPRINTS, "op7_urlfilter": OP7_URLFILTER, "op11_filter_audit": OP11_FILTER_AUDIT, "op13_centroids": _centroids()}
