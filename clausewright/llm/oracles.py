"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from .licenses import KNOWN, STEPS
from .repetition import MAX_COVERAGE, MAX_DUP_LINE_CHARS, MAX_DUP_LINES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

URLS = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UP}', '{LOW}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(rhost, rpath, rule, v) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1),
j AS (SELECT p.page_id, host, path, rule, v FROM p LEFT JOIN m USING (page_id)),
c AS (SELECT host, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM j GROUP BY 1),
e AS (SELECT host AS src, dst, count(*) AS n FROM (
    SELECT host, translate(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)), '{UP}', '{LOW}') AS dst FROM p)
  WHERE host <> '' AND dst <> '' AND host <> dst GROUP BY 1, 2),
f AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e),
g AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM e),
t(host, seed, k, score) AS (
  SELECT host, a / sum(a) OVER () AS seed, 0, 0.15 * a / sum(a) OVER () FROM c
  UNION ALL
  SELECT host, seed, k + 1, 0.15 * seed + 0.85 * coalesce((SELECT sum(x.score * f.share) FROM t x JOIN f ON f.src = x.host WHERE f.dst = t.host), 0) FROM t WHERE k < 130),
d(host, seed, k, score) AS (
  SELECT host, b / sum(b) OVER () AS seed, 0, 0.15 * b / sum(b) OVER () FROM c
  UNION ALL
  SELECT host, seed, k + 1, 0.15 * seed + 0.85 * coalesce((SELECT sum(x.score * g.share) FROM d x JOIN g ON g.src = x.host WHERE g.dst = d.host), 0) FROM d WHERE k < 130)
SELECT page_id, j.host, path, rule, round(coalesce(t.score, 0), 12) AS trust, round(coalesce(d.score, 0), 12) AS distrust,
  coalesce(v, CASE WHEN round(coalesce(d.score, 0), 12) > round(coalesce(t.score, 0), 12) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN (SELECT * FROM t WHERE k = 130) t ON t.host = j.host LEFT JOIN (SELECT * FROM d WHERE k = 130) d ON d.host = j.host
"""

BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{BENCH_WORD}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{BENCH_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, ns WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, i, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""

def _gram(n: int) -> str:
    """The n-gram from each word on; null near the end of the text."""
    return "concat(" + ", ' ', ".join(["w", *(f"lead(w, {j}) OVER o" for j in range(1, n))]) + f"), lead(i, {n - 1}) OVER o AS z"


def _coverage(n: int) -> str:
    return (
        f"a{n} AS (SELECT doc_id, i, w, {_gram(n).replace('), lead', ') AS g, lead')} FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
        f"l{n} AS (SELECT doc_id, i, w, z IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, z IS NULL, g ORDER BY i) > 1 AS later FROM a{n}), "
        f"k{n} AS (SELECT doc_id, length(w) AS n, max(CASE WHEN later THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM l{n}), "
        f"c{n} AS (SELECT doc_id, sum(CASE WHEN inside = 1 THEN n ELSE 0 END) AS c{n} FROM k{n} GROUP BY 1)"
    )


REPETITION = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
ln AS (SELECT doc_id, line, k, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again, length(array_to_string(regexp_extract_all(line, '{WORD}'), '')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM d) WHERE regexp_matches(line, '{WORD}')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup, coalesce(sum(n) FILTER (again), 0) AS dup_chars FROM ln GROUP BY 1),
{", ".join(_coverage(n) for n in MAX_COVERAGE)},
t5 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM a5 WHERE z IS NOT NULL),
r5 AS (SELECT u.doc_id, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM u LEFT JOIN t5 USING (doc_id, i)),
rep AS (SELECT doc_id, sum(inside) AS n_rep FROM r5 GROUP BY 1),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d),
f AS (SELECT b.*, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n_rep, 0) > 20 * n_words AS base_failed,
  coalesce(n_dup, 0) > {MAX_DUP_LINES} * coalesce(n_lines, 0) OR coalesce(dup_chars, 0) > {MAX_DUP_LINE_CHARS} * word_chars{"".join(f" OR coalesce(c{n}, 0) > {x} * word_chars" for n, x in MAX_COVERAGE.items())} AS bad
  FROM b LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in MAX_COVERAGE)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM f
"""


def _canonical(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, {_q(pattern)}, " + (r"chr(10)" if by == r"\n" else _q(by)) + ", 'g')"
    return out


LICENSES = f"""
WITH k AS (SELECT sha256({_canonical("body")}) AS digest, min(license) AS license
  FROM (VALUES {", ".join(f"({_q(a)}, {_q(b)})" for a, b in KNOWN.items())}) t(license, body) GROUP BY 1),
d AS (SELECT doc_id, {_canonical("text")} AS form FROM documents)
SELECT doc_id, CASE WHEN form = '' THEN 0 ELSE length(regexp_replace(form, '[^ ]+', '', 'g')) + 1 END::BIGINT AS canonical_words, sha256(form) AS digest, license
FROM d LEFT JOIN k ON k.digest = sha256(form)
"""

_H = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
FILL_IN_MIDDLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT doc_id, t, n, {_H} FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
  ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END AS output FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END::BIGINT AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

SQL = {
    "op4_url_filters": URLS,
    "op5_benchmark_decontamination": CONTAMINATION,
    "op9_license_scans": LICENSES,
    "op10_quality_rules": REPETITION,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_embedding_near_dedup": NEAR_VECTORS,
}
