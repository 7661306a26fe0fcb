"""DuckDB SQL of the operators that SQL can express, written apart from them."""

from __future__ import annotations

from .centroids import CENTROIDS, COMPONENTS, ROUNDS, SCALE
from .centroids import SEED as ORDER_SEED
from .mixing import DOMAIN_WEIGHTS, EPOCHS, LANG_WEIGHTS, SEED, TOTAL
from .radix_dedup import OP3_SQL
from .secret_scan import ACCESS, ASSIGN, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, HEX, LIVE_CHARACTERS, TOKEN


def _case(column: str, table: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END"


def _filled(children: str, parent: str) -> str:
    """Water-filling: the children in order of cap per weight, full ones first, the rest by weight."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""(SELECT * EXCLUDE (left_, weight_, full_), CASE WHEN full_ THEN cap ELSE CAST(CAST(weight AS HUGEINT) * first_value(left_) OVER z // first_value(weight_) OVER z AS BIGINT) END AS got
 FROM (SELECT *, CAST(cap AS HUGEINT) * weight_ <= CAST(weight AS HUGEINT) * left_ AS full_ FROM
  (SELECT *, budget - coalesce(sum(cap) OVER w, 0) AS left_, sum(weight) OVER (ROWS_OF) - coalesce(sum(weight) OVER w, 0) AS weight_ FROM {children} c
   WINDOW w AS ({by} ORDER BY cap / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) c1) c2 WINDOW z AS ({by} ORDER BY full_, cap / weight, name))""".replace("ROWS_OF", by)


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(CAST(CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4 AS VARCHAR), 'unknown') AS domain, coalesce(lang, 'unknown') AS lang,
  coalesce(source, 'unknown') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {EPOCHS} AS cap FROM d GROUP BY ALL),
total AS (SELECT CAST(floor(sum(n_tokens) * {TOTAL}) AS BIGINT) AS t FROM d),
l1 AS (SELECT domain, domain AS name, sum(cap) AS cap, {_case('domain', DOMAIN_WEIGHTS)} AS weight, (SELECT t FROM total) AS budget FROM leaf GROUP BY domain),
b1 AS (SELECT domain, got FROM {_filled('l1', '')} x),
l2 AS (SELECT leaf.domain, lang, lang AS name, sum(cap) AS cap, {_case('lang', LANG_WEIGHTS)} AS weight, any_value(got) AS budget FROM leaf JOIN b1 ON leaf.domain = b1.domain GROUP BY leaf.domain, lang),
b2 AS (SELECT domain, lang, got FROM {_filled('l2', 'domain')} x),
l3 AS (SELECT leaf.domain, leaf.lang, source, source AS name, cap, 1 AS weight, got AS budget FROM leaf JOIN b2 ON leaf.domain = b2.domain AND leaf.lang = b2.lang),
b3 AS (SELECT domain, lang, source, got FROM {_filled('l3', 'domain, lang')} x),
plan AS (SELECT leaf.domain, leaf.lang, leaf.source, got AS budget, got // tokens AS passes, got % tokens AS need FROM leaf JOIN b3 ON leaf.domain = b3.domain AND leaf.lang = b3.lang AND leaf.source = b3.source WHERE tokens > 0),
o AS (SELECT d.*, budget, passes, need, md5('{SEED}:' || passes || ':' || doc_id) AS key FROM d LEFT JOIN plan p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source),
r AS (SELECT *, coalesce(need, 0) - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM o)
SELECT doc_id, domain, lang, source, n_tokens, CAST(coalesce(budget, 0) AS BIGINT) AS budget, CAST(coalesce(passes, 0) + CASE WHEN left_ > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies,
 CAST(coalesce(passes, 0) * n_tokens + greatest(0, least(left_, n_tokens)) AS BIGINT) AS taken FROM r
"""

OP4_SQL = """
WITH RECURSIVE fine AS (SELECT vec_id, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id
  AND list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN comp ON vec_id = id LEFT JOIN deg ON vec_id = a
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20) x),
dup AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM win) y WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM dup),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS n FROM
  (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits(rank: int, pattern: str, group: int, least: int) -> str:
    p = _q(pattern)
    between = f"string_split_regex(text, {p})"
    return f"""SELECT doc_id, repository, owner, {rank} AS rank, v AS value, s AS start_, s + length(hit) AS end_ FROM (
 SELECT *, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS s, hits[k] AS hit, vals[k] AS v FROM (
  SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (
   SELECT doc_id, repository, owner, {between} AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS vals FROM d) a) b) c WHERE length(v) >= {least}"""


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang) AS repository, coalesce(source, '') AS owner FROM documents),
item AS ({_hits(0, ASSIGN, 2, 6)} UNION ALL {_hits(1, ACCESS, 1, 20)} UNION ALL {_hits(2, HEX, 1, 24)}
 UNION ALL SELECT * FROM ({_hits(3, TOKEN, 1, 20)}) t WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
spread AS (SELECT value, count(DISTINCT owner) AS n, count(DISTINCT repository) AS m FROM item GROUP BY value),
judged AS (SELECT i.*, CASE WHEN n >= {EXAMPLE_OWNERS} OR m >= {EXAMPLE_REPOSITORIES} THEN 'example' WHEN len(list_distinct(string_split(i.value, ''))) >= {LIVE_CHARACTERS} THEN 'live' ELSE 'weak' END AS status
 FROM item i JOIN spread s ON i.value = s.value),
found AS (SELECT *, ['assign', 'access', 'hex', 'live'][rank + 1] || ':' || CAST(start_ AS BIGINT) || ':' || CAST(end_ AS BIGINT) AS span FROM judged j WHERE rank < 3
 OR (status = 'live' AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.doc_id = j.doc_id AND b.rank < 3 AND b.start_ < j.end_ AND j.start_ < b.end_)))
SELECT d.doc_id, count(span) FILTER (WHERE rank = 0) AS n_assign, count(span) FILTER (WHERE rank = 1) AS n_access, count(span) FILTER (WHERE rank = 2) AS n_hex,
 sha256(coalesce(string_agg(span, ',' ORDER BY start_, rank) FILTER (WHERE rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start_, rank), '') AS spans,
 count(span) FILTER (WHERE status = 'live') AS n_live, count(span) FILTER (WHERE status = 'example') AS n_example
FROM d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""

def _base32(digest: str) -> str:
    """Base32 of hexadecimal digits: five bits a letter, out of the two digits that hold them."""
    digit = lambda at: f"(strpos('0123456789abcdef', substr({digest} || '0', {at}, 1)) - 1)"
    letters = [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({digit(5 * n // 4 + 1)} * 16 + {digit(5 * n // 4 + 2)}) // {1 << (3 - 5 * n % 4)}) % 32 + 1 AS BIGINT), 1)" for n in range(32)]
    return " || ".join(letters)


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, sha1(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_base32('digest')} AS payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM g
"""

def _round(n: int) -> str:
    """Vectors at their nearest centroids of round ``n``, and the centroids after it."""
    return f"""near{n} AS MATERIALIZED (SELECT row_id, x, k, d FROM (SELECT row_id, x, k, d, row_number() OVER (PARTITION BY row_id ORDER BY d, k) AS place FROM
  (SELECT row_id, x, k, list_sum(list_transform(range(1, {COMPONENTS + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM whole, c{n}) a) b WHERE place = 1),
mean{n} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, (s - ((s % n + n) % n)) // n AS m FROM (SELECT k, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM
  (SELECT k, x, unnest(range(1, {COMPONENTS + 1})) AS i FROM near{n}) a GROUP BY k, i) b) e GROUP BY k),
c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(mean{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN mean{n} ON c{n}.k = mean{n}.k)"""


OP12_SQL = f"""
WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT sha256(concat('{ORDER_SEED}:', coalesce(CAST(vec_id AS VARCHAR), 'none'))) AS h, x FROM whole ORDER BY h, x LIMIT {CENTROIDS}) a),
{", ".join(_round(n) for n in range(ROUNDS + 1))}
SELECT w.vec_id, CAST(n.k AS INTEGER) AS "cluster", CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY n.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(c, lambda e: CAST(e AS VARCHAR)), ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN whole w ON n.row_id = w.row_id JOIN c{ROUNDS} ON n.k = c{ROUNDS}.k
"""

SQL = {
    "op2_source_mix": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_multi_index": OP4_SQL,
    "op8_debruijn_dedup": OP8_SQL,
    "op9_secret_scan": OP9_SQL,
    "op11_warc_chain": OP11_SQL,
    "op12_centroids": OP12_SQL,
}
