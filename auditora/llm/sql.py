"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import licenses, mixing

_SPACE = r"[\x20\x09-\x0D]"


def mix_sql(seed: str = "mix-1", epochs: float = 1.0, temperature: float = 0.5) -> str:
    part = mixing.PART_MEAN
    unit = f"(('0x' || substr(md5('{seed}:n:' || j || ':' || k), 1, 12))::BIGINT / {float(1 << mixing.HASH_BITS)!r}::DOUBLE)"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, ''))) AS k FROM documents),
raw AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temperature!r}::DOUBLE) AS w FROM d GROUP BY source),
sizes AS (SELECT source, n, w / max(w) OVER () AS w FROM raw),
total AS (SELECT sum(n)::DOUBLE AS all_n, sum(w::DECIMAL(38,18))::DOUBLE AS all_w FROM sizes),
rates AS (SELECT source, {epochs!r}::DOUBLE * all_n * w / all_w / n AS rate FROM sizes, total),
parts AS (SELECT source, rate, greatest(1, ceil(rate / {part!r}))::INTEGER AS parts FROM rates),
means AS (SELECT source, parts, rate / parts AS m, (ceil(rate / parts + 12 * sqrt(rate / parts)) + 30)::INTEGER AS kmax FROM parts),
cdf AS (
  SELECT source, parts, m, kmax, 0 AS i, exp(-m) AS p, exp(-m) AS c FROM means
  UNION ALL
  SELECT source, parts, m, kmax, i + 1, p * m / (i + 1), c + p * m / (i + 1) FROM cdf WHERE i < kmax),
tables AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY i) AS cs FROM cdf GROUP BY source),
draws AS (
  SELECT d.doc_id, d.source, d.text,
         list_sum(list_transform(range(1, t.parts + 1), lambda j: len(list_filter(t.cs, lambda c: c <= {unit}))))::INTEGER AS n
  FROM d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy, md5(text) AS text_md5 FROM draws WHERE n > 0
"""


def license_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.KNOWN.items())
    steps, last = [], "s0"
    for n, (ids, name) in enumerate(licenses.RULES, 1):
        seq = "".join(f"<{i}>" for i in ids)
        steps.append(f"s{n} AS (SELECT doc_id, ids, replace(rest, '{seq}', '|') AS rest, CASE WHEN contains(rest, '{seq}') "
                     f"AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"s{n}"

    def cut(low: str) -> str:
        norm = f"trim(regexp_replace(x, '[^a-z0-9.+]+', ' ', 'g'), ' .')"
        ids = (f"array_to_string(list_transform(string_split(regexp_replace({low}, '({licenses.END}){_SPACE}+', '\\1' || chr(10), 'g'), chr(10)), "
                f"lambda x: coalesce(known.m[{norm}], '')), '')")
        for pattern, instead in licenses.LONE_NAMES:
            ids = f"regexp_replace({ids}, '{pattern}', '{instead}', 'g')"
        return ids

    count = "(length({0}) - length(replace({0}, '<', '')))"
    return f"""
WITH known AS (SELECT map_from_entries(list((s, i))) AS m FROM (VALUES {known}) v(s, i)),
low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
cuts AS (SELECT doc_id, {cut('t')} AS a, {cut(f"regexp_replace(t, '{_SPACE}+', ' ', 'g')")} AS b FROM low, known),
s0 AS (SELECT doc_id, ids, ids AS rest, []::VARCHAR[] AS found FROM (
  SELECT doc_id, CASE WHEN {count.format('b')} > {count.format('a')} THEN b ELSE a END AS ids FROM cuts) z),
{", ".join(steps)}
SELECT doc_id, {count.format('ids')}::INTEGER AS n_known, ids AS sentence_ids, array_to_string(found, ',') AS licenses,
       replace(rest, '|', '') AS unmatched FROM {last}
"""


MIX_SQL = mix_sql()
LICENSE_SQL = license_sql()
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 20
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIVERGENCE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM tok GROUP BY 1, 2, 3),
keep AS (SELECT lang, term, sum(n)::HUGEINT AS ln FROM cnt GROUP BY 1, 2 HAVING sum(docs) >= 3),
langs AS (SELECT lang, sum(ln)::HUGEINT AS total, count(*) AS v FROM keep GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.ln FROM grp g JOIN keep k USING (lang) LEFT JOIN cnt c USING (lang, source, term)),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY 1, 2),
sh AS (
  SELECT o.lang, o.source, o.term, o.n, 1 + (1000000000 * (o.n + 1)) // (t.total + l.v) AS p, 1 + (1000000000 * (o.ln + 1)) // (l.total + l.v) AS q
  FROM own o JOIN tot t USING (lang, source) JOIN langs l USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
             FROM sh x JOIN sh y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM sh WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, rank::INTEGER
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM best) z WHERE rank <= 200
"""

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a; ``ins`` closes a state under up to three insertions.
TURN_SQL = """
WITH RECURSIVE
tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
        FROM (SELECT unnest(range(256))::BIGINT AS i) z),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT conv_id, turn, role, text,
               xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT),
                               lambda c, b: xor(tab.t[xor(c % 256, b) + 1], c // 256), 4294967295::BIGINT), 4294967295) % 20 AS h FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again FROM crc WHERE h <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), again) AS i,
               rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
flt AS (SELECT *, CASE WHEN body = '' THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
               role[1] || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM num),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM flt GROUP BY conv_id),
step(q, c, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins AS (
  SELECT q AS f, q AS r, 0 AS cost, '' AS audit, '' AS lines FROM (VALUES (0), (1), (2), (3)) v(q)
  UNION ALL
  SELECT f, s.r, cost + 3, audit || 'I', lines || chr(10) || CASE s.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END
  FROM ins JOIN step s ON s.q = ins.r WHERE s.c <> 's' AND length(audit) < 3),
edit AS (
  SELECT conv_id, i, 4 AS cost, 'D' AS audit, NULL AS c, '' AS line FROM flt
  UNION ALL
  SELECT conv_id, i, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', role[1], chr(10) || role || ':' || text FROM flt
  WHERE fault NOT IN ('blank', 'duplicate') AND role[1] IN ('s', 'u', 'a')
  UNION ALL
  SELECT conv_id, i, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', r.c, chr(10) || r.role || ':' || text
  FROM flt, (VALUES ('u', 'user'), ('a', 'assistant')) r(c, role) WHERE fault NOT IN ('blank', 'duplicate')),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM stat
  UNION ALL
  SELECT conv_id, i, q, w.cost, w.audit, w.lines FROM (
    SELECT conv_id, i, q, min({'cost': cost, 'audit': audit, 'lines': lines}) AS w FROM (
      SELECT w.conv_id, e.i, CASE WHEN e.c IS NULL THEN x.r ELSE s.r END AS q, w.cost + x.cost + e.cost AS cost,
             w.audit || x.audit || e.audit AS audit, w.lines || x.lines || e.line AS lines
      FROM walk w JOIN ins x ON x.f = w.q JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1
      LEFT JOIN step s ON s.q = x.r AND s.c = e.c WHERE e.c IS NULL OR s.r IS NOT NULL) z GROUP BY conv_id, i, q) y),
done AS (
  SELECT conv_id, min({'cost': w.cost + x.cost, 'audit': w.audit || x.audit, 'lines': w.lines || x.lines}) AS b
  FROM walk w JOIN stat t USING (conv_id) JOIN ins x ON x.f = w.q WHERE w.i = t.n AND x.r IN (0, 3) GROUP BY conv_id)
SELECT c.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0)::BIGINT AS blank, coalesce(t.duplicate, 0)::BIGINT AS duplicate,
       coalesce(t.truncated, 0)::BIGINT AS truncated, coalesce(t.illegal, 0)::BIGINT AS illegal, coalesce(d.b.cost, 0)::BIGINT AS cost,
       coalesce(d.b.audit, '') AS audit, sha256(coalesce(substr(d.b.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stat t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
