"""DuckDB SQL of the queries that SQL can express.

Each is written from the definitions, window by window and row by row, and
shares with the operators only the tables of fixed values.
"""

from __future__ import annotations

import math
import string

from cuelight.llm import secrets as S
from cuelight.llm import spotsigs as P
from cuelight.llm import urls as U

# Patterns as the contract gives them, in this engine's dialect.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def _matches(name: str, pattern: str, group: int) -> str:
    """``doc_id, start, finish, size, m`` of all matches; a match starts after all texts between and before."""
    return f"""
{name}_lists AS (SELECT doc_id, row, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS b
  FROM d WHERE regexp_matches(t, '{pattern}')),
{name}_rows AS (SELECT doc_id, row, i, length(m[i]) AS size, length(g[i]) AS own, m[i] AS m, length(b[i]) AS gap FROM {name}_lists, unnest(range(1, len(m) + 1)) AS r(i)),
{name} AS (SELECT doc_id, row, m, own, CAST(sum(gap + size) OVER (PARTITION BY row ORDER BY i) - size AS BIGINT) AS start, size FROM {name}_rows)"""


def secrets_sql() -> str:
    parts = [_matches(k, p, g) for k, (p, g, _) in BASE.items()]
    base = " UNION ALL ".join(
        f"SELECT doc_id, row, start, {i} AS rank, start + size AS finish, '{k}' AS kind FROM {k} WHERE own >= {least}" for i, (k, (_, _, least)) in enumerate(BASE.items())
    )
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in S.ALLOWED)
    limit = {k: math.floor((math.log2(S.WINDOW) - bits) * S.WINDOW * 1_000_000) for k, bits in S.THRESHOLDS.items()}
    w = S.WINDOW
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents), {', '.join(parts)}, {_matches('cand', S.CANDIDATE, 0)},
base AS ({base}),
usable AS (SELECT *, CASE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN {limit['hex']} WHEN regexp_matches(m, '^([^A-Z]+|[^a-z]+)$') THEN {limit['single']} ELSE {limit['mixed']} END AS most
  FROM cand WHERE NOT ({allowed})),
windows AS (SELECT row, doc_id, start, i, most, substr(m, i, {w}) AS win FROM usable, unnest(range(1, size - {w - 2})) AS r(i)),
hot AS (SELECT row, doc_id, start, i FROM windows
  WHERE list_sum(list_transform(list_distinct(string_split(win, '')), lambda x: ({S.TERMS})[{w} - length(replace(win, x, '')) + 1])) <= most),
islands AS (SELECT *, sum(CASE WHEN i - before <= {w} THEN 0 ELSE 1 END) OVER (PARTITION BY row, start ORDER BY i) AS island
  FROM (SELECT *, lag(i) OVER (PARTITION BY row, start ORDER BY i) AS before FROM hot)),
spans AS (SELECT row, doc_id, start + min(i) - 1 AS start, 3 AS rank, start + max(i) - 1 + {w} AS finish, 'entropy' AS kind FROM islands GROUP BY row, doc_id, start, island),
extra AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = s.row AND b.start <= s.start AND b.finish >= s.finish)),
told AS (SELECT row, start, rank, finish, kind, kind || ':' || start || ':' || finish AS one FROM (SELECT row, start, rank, finish, kind FROM base UNION ALL SELECT row, start, rank, finish, kind FROM extra)),
sums AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(one, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(one, ',' ORDER BY start, rank) AS every FROM told GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN sums USING (row)"""


def spotsigs_sql() -> str:
    anchors = ", ".join(f"'{a}'" for a in P.ANCHORS)
    chain = ", ".join(f"w[c[k + {j}]]" for j in range(P.CHAIN))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS row FROM documents),
n AS (SELECT *, length(t) // 2 AS half, coalesce(lead(t) OVER (ORDER BY row), first(t) OVER (ORDER BY row)) AS next_t FROM d),
e AS (SELECT *, substr(t, 1, length(t) - half) || substr(next_t, 1, half) AS edited FROM n),
texts AS (SELECT row, 0 AS part, t FROM e UNION ALL SELECT row, 1, edited FROM e),
split AS (SELECT row, part, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM texts),
content AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN ({anchors})) AS c FROM split),
spots AS (SELECT *, list_transform(list_filter(range(1, len(c) + 1), lambda k: c[k] > 1 AND w[greatest(c[k] - 1, 1)] IN ({anchors})),
            lambda k: concat_ws(' ', w[c[k] - 1], {chain})) AS s FROM content),
marks AS (SELECT row, part, list_sort(list_distinct(list_transform(CASE WHEN len(s) > 0 THEN s ELSE ['all ' || coalesce(array_to_string(w, ' '), '')] END, lambda x: md5(x)[1:{P.DIGITS}]))) AS m FROM spots),
paired AS (SELECT e.doc_id, e.row, length(e.t) AS n_chars, sha256(e.edited) AS edited_sha256, a.m AS a, b.m AS b FROM e JOIN marks a ON a.row = e.row AND a.part = 0 JOIN marks b ON b.row = e.row AND b.part = 1),
near AS (SELECT *, coalesce(lead(a) OVER (ORDER BY row), first(a) OVER (ORDER BY row)) AS nx FROM paired)
SELECT doc_id, n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS near_edited,
       len(list_intersect(a, nx)) / (len(a) + len(nx) - len(list_intersect(a, nx))) AS near_next
FROM near"""


def urls_sql() -> str:
    start, stop = f"repeat(chr(2), {U.ORDER})", "chr(3)"
    rules = sorted(U.RULES, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"

    name = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in rules) + " END"
    says = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{s}'" for s, r in rules) + " END"
    levels = []
    for k in range(1, U.ORDER + 1):
        levels.append(f"""
level{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(na) AS na, sum(nr) AS nr FROM counts GROUP BY 1),
seen{k} AS (SELECT left(gram, {k}) AS context, sum(na) AS all_a, sum(nr) AS all_r, count(*) FILTER (na > 0) AS kinds_a, count(*) FILTER (nr > 0) AS kinds_r FROM level{k} GROUP BY 1),
model{k} AS (SELECT l.gram, CASE WHEN all_a > 0 THEN (l.na + kinds_a * pa) / (all_a + kinds_a) ELSE pa END AS pa, CASE WHEN all_r > 0 THEN (l.nr + kinds_r * pr) / (all_r + kinds_r) ELSE pr END AS pr
  FROM level{k} l JOIN seen{k} ON context = left(l.gram, {k}) JOIN model{k - 1} b ON b.gram = right(l.gram, {k}))""")
    return f"""
WITH raw AS (SELECT page_id, coalesce(url, '') AS body, regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
hosts AS (SELECT page_id, body, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM raw),
parsed AS (SELECT *, {name} AS rule, {says} AS says FROM hosts),
bodies AS (SELECT body, any_value(says) AS says, ascii(md5(body)) % 2 AS half FROM parsed WHERE body <> '' GROUP BY body),
grams AS (SELECT body, says, half, substr({start} || body || {stop}, i, {U.ORDER + 1}) AS gram FROM bodies, unnest(range(1, length(body) + 2)) AS r(i)),
counts AS (SELECT gram, CAST(count(*) FILTER (says = 'allow' AND half = 0) AS DOUBLE) AS na, CAST(count(*) FILTER (says = 'block' AND half = 0) AS DOUBLE) AS nr FROM grams GROUP BY gram),
single AS (SELECT right(gram, 1) AS gram, sum(na) AS na, sum(nr) AS nr FROM counts GROUP BY 1),
model0 AS (SELECT gram, (na + 1) / ((SELECT sum(na) FROM single) + {U.ALPHABET}) AS pa, (nr + 1) / ((SELECT sum(nr) FROM single) + {U.ALPHABET}) AS pr FROM single), {', '.join(levels)},
scored AS (SELECT body, any_value(says) AS says, avg(ln(pa) - ln(pr)) AS score FROM grams JOIN model{U.ORDER} USING (gram) WHERE says IS NULL OR half = 1 GROUP BY body),
held AS (SELECT avg(score) FILTER (says = 'allow') AS a, avg(score) FILTER (says = 'block') AS r, coalesce(stddev_samp(score) FILTER (says = 'allow'), 0) AS sa, coalesce(stddev_samp(score) FILTER (says = 'block'), 0) AS sr FROM scored),
edge AS (SELECT coalesce(CASE WHEN sa + sr > 0 THEN (a * sr + r * sa) / (sa + sr) ELSE (a + r) / 2 END, CAST('-infinity' AS DOUBLE)) AS threshold FROM held)
SELECT page_id, host, path, rule, coalesce(p.says, CASE WHEN score >= threshold OR score IS NULL THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM parsed p LEFT JOIN (SELECT body, score FROM scored WHERE says IS NULL) s USING (body), edge"""


def trie_sql() -> str:
    """Every node by the digest of its prefix, joined to its ancestors one by one."""
    crc = """xor(list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT),
  lambda crc, byte: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, byte)), 4294967295), 4294967295)"""
    return f"""
WITH said AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, h FROM (SELECT c AS conv_id, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM said))),
heads AS (SELECT c.conv_id, s.p, s.role, s.text FROM convs c JOIN said s ON s.conv_id = c.base AND s.p <= c.h),
turns AS (SELECT * FROM heads UNION ALL
  SELECT conv_id, 100 + p, role, text FROM said JOIN convs USING (conv_id) WHERE p > h),
chained AS (SELECT conv_id, strlen(text) AS size, row_number() OVER w AS depth, md5(string_agg(md5(role) || md5(text), '') OVER w) AS prefix FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
members AS (SELECT conv_id, depth, prefix, size FROM chained UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS ends FROM members GROUP BY conv_id),
nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
  string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = ends) AS ids FROM members JOIN lengths USING (conv_id) GROUP BY depth, prefix),
up AS (SELECT n.depth, n.prefix, m.prefix AS parent FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
below AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS children FROM up GROUP BY ALL),
sums AS (SELECT a.depth, a.prefix, count(*) FILTER (b.children IS NULL) AS leaves, sum((n.n - 1) * n.size) AS saved
  FROM nodes n JOIN members a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN below b ON b.depth = n.depth AND b.prefix = n.prefix GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(b.children, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (depth, prefix) LEFT JOIN below b USING (depth, prefix) LEFT JOIN up USING (depth, prefix) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = up.parent"""


def spelling_sql() -> str:
    """Near words by what each is without one of its code points; forms followed one by one."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex(encode(said))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(said)), 2 * i - 1, 2))::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"""
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(run, '{upper}', '{lower}') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
told AS (SELECT run, n, {crc} AS h FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS said FROM runs)),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM told),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.part
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.part),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way w USING (word) JOIN forms last ON last.word = w.at AND last.form IS NULL"""
