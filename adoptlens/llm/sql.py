"""The corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

from . import mixing, vector_codes
from .common import LOWER, UPPER

ROUNDS = 24
WORD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
  FROM words
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = r.doc_id AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

REPEATS = """
WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS MATERIALIZED (SELECT doc_id, unnest(range(len(h) // 2 - 49)) AS p, h FROM b WHERE len(h) >= 100),
w AS MATERIALIZED (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM x),
f AS MATERIALIZED (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS MATERIALIZED (SELECT doc_id, p, p > 50 + lag(p, 1, -100) OVER (PARTITION BY doc_id ORDER BY p) AS new
  FROM w JOIN f USING (s) WHERE first < doc_id),
i AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g),
spans AS MATERIALIZED (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, island),
k AS (SELECT s.doc_id, coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS c, a, z, h FROM spans s JOIN b USING (doc_id)),
t AS (SELECT doc_id, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept,
  count(*) AS n_spans, sum(z - a) AS n_removed FROM k GROUP BY doc_id)
SELECT b.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN t USING (doc_id)
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages
), d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, keep FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 10 * (k // 8), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM d
"""

LINE_DEDUP = f"""
WITH l AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS p
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), k AS MATERIALIZED (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), often AS MATERIALIZED (
  SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT k.*, keep_id IS NOT NULL AND keep_id <> doc_id AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL_SEARCH = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents
), s AS MATERIALIZED (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
m AS MATERIALIZED (SELECT doc_id, 50 + (50 * len(t) * big_n) // big_l AS m FROM d, s WHERE len(t) > 0),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(
  translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
w AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term
), r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 50
"""


def _mixing() -> str:
    steps, last = [], "w0"
    dims = ", ".join(mixing.DIMENSIONS)
    # as many rounds as the tables need to come within the tolerance
    for k in range(ROUNDS * len(mixing.DIMENSIONS)):
        d = mixing.DIMENSIONS[k % len(mixing.DIMENSIONS)]
        steps.append(
            f"w{k + 1} AS MATERIALIZED (SELECT {dims}, n, w * share / sum(w) OVER (PARTITION BY {d}) AS w "
            f"FROM {last} JOIN (SELECT {d} AS k, share FROM t_{d}) t ON t.k IS NOT DISTINCT FROM {d})"
        )
        last = f"w{k + 1}"
    marginals = ",\n".join(
        f"t_{d} AS MATERIALIZED (SELECT {d}, pow(n, {mixing.POWERS[d]}) / sum(pow(n, {mixing.POWERS[d]})) OVER () AS share "
        f"FROM (SELECT {d}, sum(n) AS n FROM cells GROUP BY {d}))"
        for d in mixing.DIMENSIONS
    )
    return f"""
WITH topics AS (
  SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'toxic' WHEN min(quality) = 1 THEN 'good' ELSE 'plain' END AS topic
  FROM labels GROUP BY doc_id
), d AS MATERIALIZED (
  SELECT doc_id, source, lang, coalesce(topic, 'none') AS topic,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / {float(16**13)!r} AS number
  FROM documents LEFT JOIN topics USING (doc_id)
), cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL),
{marginals},
w0 AS MATERIALIZED (SELECT {dims}, n, n / sum(n) OVER () AS w FROM cells),
{",".join(steps)},
errors AS ({" UNION ALL ".join(f"SELECT max(abs(x / share - 1)) AS e FROM (SELECT {d} AS k, sum(w) AS x FROM {last} GROUP BY 1) s JOIN t_{d} t ON t.{d} IS NOT DISTINCT FROM k" for d in mixing.DIMENSIONS)}),
chances AS (SELECT {dims}, CASE WHEN n > 0 THEN round((w / n) / max(w / n) OVER (), {mixing.DIGITS}) ELSE 1.0 END AS p FROM {last})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, p AS probability, number < p AS kept,
  (SELECT max(e) <= {mixing.ON_TARGET!r} FROM errors) AS on_target
FROM d JOIN chances c ON c.source IS NOT DISTINCT FROM d.source AND c.lang IS NOT DISTINCT FROM d.lang
  AND c.topic IS NOT DISTINCT FROM d.topic
"""


MIXING = _mixing()


def _vector_codes() -> str:
    # distances and entries in one number: the least has the lower index of equal distances
    books, last = [], "c0"
    assigned = (
        "SELECT vec_id, part, min(dist * {n} + entry) AS best FROM (SELECT vec_id, v.part, entry, "
        "sum((v.x - c.x) * (v.x - c.x)) AS dist FROM v JOIN {last} c USING (part, place) GROUP BY ALL) GROUP BY ALL"
    )
    n = vector_codes.ENTRIES
    for k in range(vector_codes.ROUNDS):
        books.append(f"a{k} AS MATERIALIZED ({assigned.format(n=n, last=last)})")
        books.append(
            f"m{k} AS MATERIALIZED (SELECT part, CAST(best % {n} AS BIGINT) AS entry, place, sum(x) AS s, count(*) AS n "
            f"FROM v JOIN a{k} USING (vec_id, part) GROUP BY ALL)"
        )
        # division that rounds down
        books.append(
            f"c{k + 1} AS MATERIALIZED (SELECT part, entry, place, "
            f"CAST(CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS x "
            f"FROM {last} LEFT JOIN m{k} USING (part, entry, place))"
        )
        last = f"c{k + 1}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT vec_id, unnest(range(len(e))) AS i, unnest(e) AS x, len(e) // {vector_codes.PARTS} AS width FROM kept
), v AS MATERIALIZED (
  SELECT vec_id, i // width AS part, i % width AS place, CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u
), c0 AS MATERIALIZED (
  SELECT part, entry, place, x FROM v JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {n}) USING (vec_id)
),
{", ".join(books)},
z AS MATERIALIZED ({assigned.format(n=n, last=last)}),
r AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % {n} AS INT)), '' ORDER BY part) AS code,
  CAST(sum(best // {n}) AS BIGINT) AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, place)) FROM {last}) AS codebooks_sha256
FROM kept JOIN r USING (vec_id)
"""


VECTOR_CODES = _vector_codes()
