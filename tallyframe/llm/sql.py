"""DuckDB statements for those operators that SQL can express."""

from __future__ import annotations

# crc32 bit by bit: -1 stands for a shift, any other value for the next byte.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384::BIGINT * (s & 1)) END), 4294967295::BIGINT)"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


MERKLE = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS other
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
up(level, source, place, n, h) AS (
  SELECT 0, source, place, n, leaf FROM leaves
  UNION ALL
  SELECT level + 1, source, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM up WHERE n > 1 GROUP BY level, source, place // 3, n),
subroots AS (
  SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place,
         count(*) OVER () AS n
  FROM up WHERE n = 1),
above(level, place, n, h) AS (
  SELECT 0, place, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM above WHERE n > 1 GROUP BY level, place // 3, n),
ways AS (
  SELECT a.level, a.source, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM up a JOIN up b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY ALL),
higher AS (
  SELECT a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM above a JOIN above b ON a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY ALL),
steps AS (
  SELECT v.source, v.place, w.level, w.l, w.r
  FROM leaves v JOIN ways w ON v.source IS NOT DISTINCT FROM w.source AND w.place = v.place // CAST(3 ** w.level AS BIGINT)
  UNION ALL
  SELECT v.source, v.place, s.height + w.level, w.l, w.r
  FROM leaves v JOIN subroots s ON v.source IS NOT DISTINCT FROM s.source
  JOIN higher w ON w.place = s.place // CAST(3 ** w.level AS BIGINT)),
proofs AS (
  SELECT source, place, string_agg(l || r, '' ORDER BY level) AS p, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs
  FROM steps GROUP BY source, place),
folds(doc_id, leaf, source, place, p, ls, rs, k, h) AS (
  SELECT v.doc_id, v.leaf, v.source, v.place, coalesce(p, ''), ls, rs, 1, coalesce(other, leaf)
  FROM leaves v LEFT JOIN proofs q ON v.source IS NOT DISTINCT FROM q.source AND v.place = q.place
  UNION ALL
  SELECT doc_id, leaf, source, place, p, ls, rs, k + 1, sha256(ls[k] || h || rs[k]) FROM folds WHERE k <= len(ls))
SELECT f.doc_id, f.leaf, s.subroot, a.h AS root, sha256(f.p) AS proof_sha256, f.h AS folded_root, f.h = a.h AS verified
FROM folds f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT h FROM above WHERE n = 1) a
WHERE f.k > coalesce(len(f.ls), 0)
"""

DIVERGENCE = """
WITH docs AS (
  SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k
  FROM documents),
words AS (
  SELECT k, lang, source, term, count(*) AS n
  FROM (SELECT k, lang, source, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs)
  GROUP BY ALL),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(*) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
own AS (SELECT lang, source, term, sum(n) AS n FROM words GROUP BY ALL),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN own o USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM counts),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL),
langs AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM whole),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
rising AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - l.q AS value
  FROM shares s JOIN langs l USING (lang, term) WHERE s.n > 0 AND s.p > l.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM rising)
QUALIFY part = 'pair' OR rank <= 50
"""
