"""DuckDB SQL of the queries that SQL can express, each by a plainer way than the operator's."""

from __future__ import annotations


def crc32(number: str) -> str:
    """Unsigned crc32 of the decimal digits of ``number``."""
    step = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return (f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {digits}), "
            f"lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: {step})))")


#: Runs from pairs of equal 16-word windows: maximal stretches of starts that repeat at one distance
PERIODIC_RUNS = rf"""
WITH d0 AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w0,
                   {crc32("doc_id")} AS h FROM documents),
d1 AS (SELECT *, len(w0) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
d AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END])
             ELSE w0 END AS w FROM d3),
win AS (SELECT rid, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS x, n
        FROM (SELECT rid, w, n, unnest(range(n - 15)) AS i FROM d WHERE n >= 24)),
near AS (SELECT a.rid, a.i, b.i - a.i AS q FROM win a JOIN win b ON a.rid = b.rid AND a.x = b.x AND b.i > a.i
         WHERE (b.i - a.i) * 3 <= a.n),
isl AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM near),
st AS (SELECT rid, q, min(i) AS s, count(*) + 15 + q AS len FROM isl GROUP BY rid, q, g),
runs AS (SELECT rid, s, len, min(q) AS q FROM st WHERE len >= greatest(24, 3 * q) GROUP BY rid, s, len),
agg AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
               list(s ORDER BY s, q) AS ss, list(len ORDER BY s, q) AS ls, list(q ORDER BY s, q) AS qs FROM runs GROUP BY rid),
better AS (SELECT DISTINCT a.rid, a.s, a.q FROM runs a JOIN runs b ON a.rid = b.rid AND
           (b.len * a.q > a.len * b.q OR (b.len * a.q = a.len * b.q AND (b.s < a.s OR (b.s = a.s AND b.q < a.q))))),
best AS (SELECT r.rid, r.s, r.len, r.q FROM runs r ANTI JOIN better USING (rid, s, q))
SELECT d.doc_id, CAST(coalesce(agg.n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start,
       CAST(best.len AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
       CAST(1000 * best.len // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(agg.lines, '')) AS runs_sha256,
       sha256(CASE WHEN agg.rid IS NULL THEN array_to_string(d.w, ' ') ELSE array_to_string(list_filter(d.w, lambda x, k: NOT
           list_bool_or(list_transform(range(1, len(agg.ss) + 1), lambda r: k - 1 >= agg.ss[r] + agg.qs[r] AND k - 1 < agg.ss[r] + agg.ls[r]))), ' ') END)
           AS collapsed_sha256
FROM d LEFT JOIN agg USING (rid) LEFT JOIN best USING (rid)
"""


def _level(name: str, units: str) -> str:
    """Prior strength of the units (n, k, m) of a level."""
    return f"""
{name} AS (SELECT 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5),
                  1.0::DOUBLE / 1001), 0.5) - 1 AS s FROM {units} WHERE n > 0)"""


_NAME = r"regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g')"
_TWO = ("('ac.uk', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'org.uk')")

#: Rules tried on every url, then the three levels of the beta-binomial model
URL_REPUTATION = rf"""
WITH rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS rid, page_id,
             translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
hit AS (SELECT rid, arg_max(struct_pack(rule := rh || rp, v := rv), length(rh || rp) * 1000 + length(rh)) AS r
        FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
j AS (SELECT p.*, r.rule AS rule, r.v AS rv FROM p LEFT JOIN hit USING (rid)),
hosts AS (SELECT host, string_split({_NAME}, '.') AS l, CAST(count(rule) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE rv = 'block') AS DOUBLE) AS k
          FROM j GROUP BY host),
h1 AS (SELECT host, n, k, l, CASE WHEN array_to_string(l[-2:], '.') IN {_TWO} THEN 2 ELSE 1 END AS w FROM hosts),
h AS (SELECT host, n, k, array_to_string(l[-w:], '.') AS suffix, array_to_string(l[-w - 1:], '.') AS domain FROM h1),
su AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM h) AS m FROM h GROUP BY suffix),
{_level("s1", "su").lstrip()},
dm AS (SELECT d.domain, d.n, d.k, (su.k + s1.s * su.m) / (su.n + s1.s) AS m
       FROM (SELECT domain, max(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain) d JOIN su USING (suffix), s1),
{_level("s2", "dm").lstrip()},
hm AS (SELECT h.host, h.n, h.k, (dm.k + s2.s * dm.m) / (dm.n + s2.s) AS m FROM h JOIN dm USING (domain), s2),
{_level("s3", "hm").lstrip()},
ab AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM hm, s3),
rate AS (SELECT host, a / (a + b) AS rate, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
SELECT CAST(page_id AS BIGINT) AS page_id, host, path, rule,
       coalesce(rv, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 6) AS block_rate, round(bound, 6) AS block_bound
FROM j JOIN rate USING (host)
"""

#: Every prefix of every rebuilt conversation as one row
PREFIX_TRIE = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32("conv_id")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
x AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
             md5(string_agg(md5(strlen(role) || ':' || role || text), ',') OVER w) AS key
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
p AS (SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS key FROM c UNION ALL SELECT conv_id, depth, bytes, key FROM x),
q AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
             depth = max(depth) OVER (PARTITION BY conv_id) AS stops FROM p),
nodes AS (SELECT key, any_value(depth) AS depth, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE stops), '') AS ends
          FROM q GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
n2 AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
sub AS (SELECT a.key, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n - 1) * m.bytes) AS saved
        FROM n2 m JOIN p a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.key)
SELECT n2.conv_id, CAST(n2.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n2.n AS BIGINT) AS n_convs,
       CAST(n2.n_children AS BIGINT) AS n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(n2.ends) AS ends_sha256
FROM n2 JOIN sub USING (key) LEFT JOIN nodes up ON up.key = n2.parent
"""
