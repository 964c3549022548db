"""DuckDB SQL for the training-data queries that SQL can express.

Written from the contracts of the queries over whole tables, not from the operators' plans: windows
are compared as texts, similarities are counted pair by pair, components are a transitive
closure. The mix repeats the operator's schedule, as its result depends on it.

Operators 2, 7 and 10 rest on fitted models, 5 on a parser and 9 on 400-byte windows at
every byte, 11 on runs of every period; these are tested by brute force instead.
"""

from __future__ import annotations

from tremolo.llm import chatformat, divergence, forest, linedups, mixing

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACE = r"'[^\x20\x09-\x0D]+'"


def _words(table: str, key: str, pattern: str, text: str = "text") -> str:
    """key, w: the words of every row of a table as a list."""
    return f"SELECT {key}, regexp_extract_all(coalesce({text}, ''), {pattern}) AS w FROM {table}"


def _following(table: str, key: str, size: int) -> str:
    """key, i (from 1), g: the next ``size`` words from every place, fewer at the end."""
    return (f"SELECT {key}, i, array_agg(word) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN "
            f"CURRENT ROW AND {size - 1} FOLLOWING) AS g FROM (SELECT {key}, unnest(w) AS word, "
            f"generate_subscripts(w, 1) AS i FROM {table})")


_LOWER = f"translate(text, {_LETTERS})"

DECONTAMINATE = f"""
WITH d AS ({_words('documents', 'doc_id', _ALNUM, _LOWER)}),
b AS ({_words('benchmark', 'item_id', _ALNUM, _LOWER)}),
item_windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, len(g) AS n, array_to_string(g, ' ') AS g
  FROM ({_following('b', 'item_id', 13)}) f JOIN b USING (item_id)
  WHERE len(g) = least(13, len(w))),
places AS ({_following('d', 'doc_id', 13)}),
hits AS (
  SELECT p.doc_id, p.i, x.n, x.item_id
  FROM (SELECT doc_id, i, n, array_to_string(g[1:n], ' ') AS g
        FROM places, (SELECT DISTINCT n FROM item_windows) WHERE len(g) >= n) p
  JOIN item_windows x ON p.n = x.n AND p.g = x.g),
words_hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

SUBSTRINGS = f"""
WITH d AS ({_words('documents', 'doc_id', _SPACE)}),
windows AS (
  SELECT doc_id, i, array_to_string(g, ' ') AS g
  FROM ({_following('d', 'doc_id', 13)}) WHERE len(g) = 13),
firsts AS (SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (g) WHERE first_doc < doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

CHATS = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
                            text NULLS FIRST) AS n,
         count(*) OVER (PARTITION BY conv_id) AS n_turns, role, text
  FROM conversations),
prefixes AS (
  SELECT conv_id, n, n_turns, array_agg({{'role': role, 'text': text}}) OVER (
    PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS upto FROM turns),
kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes
  WHERE n = n_turns AND upto NOT IN (SELECT upto FROM prefixes WHERE n < n_turns) GROUP BY upto)
SELECT conv_id, (n - 1) // {chatformat.BLOCK} AS block, n_turns, n_copies, string_agg(
  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10)
  || '<|end|>' || chr(10), '' ORDER BY n) AS text
FROM turns JOIN kept USING (conv_id) GROUP BY ALL
"""

MIX = f"""
WITH sized AS (
  SELECT doc_id, source, row_number() OVER () AS id,
         CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACE})) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1
                 AS DOUBLE) AS weight, sum(source_size) OVER () AS total FROM s0),
-- the level at which all sources together give the total: it lies above those that fill up
level AS (
  SELECT max(l) AS level FROM (
    SELECT (any_value(a.total) - {mixing.MAX_EPOCHS} * sum(CASE WHEN b.source_size / b.weight
              < a.source_size / a.weight THEN b.source_size ELSE 0 END))
           / sum(CASE WHEN b.source_size / b.weight < a.source_size / a.weight
                 THEN 0 ELSE b.weight END) AS l,
           {mixing.MAX_EPOCHS} * any_value(a.source_size) / any_value(a.weight) AS cap
    FROM s1 a, s1 b GROUP BY a.source, a.weight) WHERE l < cap),
s2 AS (
  SELECT *, least({mixing.MAX_EPOCHS} * source_size, level * weight) AS target,
         greatest(1, least({mixing.MAX_BLOCK}, source_size // {mixing.PER_SOURCE})) AS block
  FROM s1, level),
s3 AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks FROM s2),
s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * n_blocks / source_size ELSE 0 END AS need
  FROM s3),
s5 AS (
  SELECT *, sum(need) OVER () AS needed, sum(need) OVER (ORDER BY source NULLS LAST) AS up,
         lead(0) OVER (ORDER BY source NULLS LAST) IS NULL AS last FROM s4),
slots AS (
  SELECT slot, (CAST(slot AS DOUBLE) * CAST({mixing.PHI!r} AS DOUBLE)) % 1.0 AS point
  FROM (SELECT unnest(range(CAST((SELECT round_even(sum(need), 0) FROM s4) AS BIGINT))) AS slot)),
times AS (
  SELECT source, r % n_blocks AS block_no, count(*) AS times FROM (
    SELECT source, n_blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r
    FROM slots JOIN s5 ON point >= (up - need) / needed
                      AND point < CASE WHEN last THEN 1.0 ELSE up / needed END)
  WHERE r < {mixing.MAX_EPOCHS} * n_blocks GROUP BY source, block_no),
placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, size, id) - size AS BIGINT)
         AS start FROM sized),
pieces AS (
  SELECT id, p.source, start, size, block,
         unnest(range(start // block, (start + size - 1) // block + 1)) AS block_no
  FROM placed p JOIN s5 s ON p.source IS NOT DISTINCT FROM s.source WHERE size > 0),
given AS (
  SELECT id, sum((least(start + size, (p.block_no + 1) * block)
                  - greatest(start, p.block_no * block)) * times) AS taken
  FROM pieces p JOIN times t ON p.source IS NOT DISTINCT FROM t.source AND p.block_no = t.block_no
  GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM sized z JOIN s5 s ON z.source IS NOT DISTINCT FROM s.source LEFT JOIN given USING (id)
"""

JACCARD = f"""
WITH RECURSIVE d AS ({_words('documents', 'doc_id, text', _SPACE)}),
texts AS (
  SELECT text, w, min(doc_id) AS t, count(*) AS copies FROM d WHERE len(w) > 0 GROUP BY text, w),
shingles AS (
  SELECT DISTINCT t, array_to_string(g, ' ') AS g
  FROM ({_following('texts', 't', forest.SHINGLE)}) f JOIN texts USING (t)
  WHERE len(g) = least({forest.SHINGLE}, len(w))),
sizes AS (SELECT t, count(*) AS n FROM shingles GROUP BY t),
links AS (
  SELECT a.t AS a, b.t AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.t <> b.t
  JOIN sizes x ON x.t = a.t JOIN sizes y ON y.t = b.t
  GROUP BY a.t, b.t, x.n, y.n
  HAVING count(*) >= {forest.THRESHOLD} * (x.n + y.n - count(*)) - 1e-6),
reach AS (
  SELECT t AS a, t AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS t, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS t, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links,
       coalesce(copies, 1) AS n_copies
FROM d LEFT JOIN texts ON d.text = texts.text LEFT JOIN classes USING (t)
LEFT JOIN counts USING (t)
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINEDUPS = f"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, {_BLANK}), {_LETTERS}) AS k
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keys AS (
  SELECT k, max(doc_id) AS largest FROM lines WHERE length(k) >= {linedups.LEAST_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {linedups.LEAST_DOCS}),
judged AS (SELECT l.*, x.k IS NOT NULL AND largest <> doc_id AS gone FROM lines l LEFT JOIN keys x USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_TERM = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"


def _price(n: str, total: str, kept: str) -> str:
    return (f"CAST(1 + (CAST({divergence.SCALE} AS HUGEINT) * ({n} + {divergence.PRIOR})) // "
            f"({total} + {divergence.PRIOR} * {kept}) AS BIGINT)")


DIVERGENCE = f"""
WITH given AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_TERM}) AS w FROM documents),
counts AS (SELECT lang, source, d, term, count(*) AS n
           FROM (SELECT lang, source, d, unnest(w) AS term FROM given) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL
         HAVING count(*) >= {divergence.LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
used AS (SELECT c.lang, source, term, CAST(sum(c.n) AS BIGINT) AS n
         FROM counts c JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM given)
  LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM used GROUP BY ALL) USING (lang, source)),
priced AS (
  SELECT g.lang, g.source, term, coalesce(u.n, 0) AS n,
         {_price('coalesce(u.n, 0)', 'g.total', 'l.v')} AS p,
         {_price('k.n', 'l.total', 'l.v')} AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN used u USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT CAST(sum(abs(x.p - y.p)) AS BIGINT) FROM priced x JOIN priced y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value
          FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""

ORACLE_SQL = {"op1_decontaminate": DECONTAMINATE, "op3_substrings": SUBSTRINGS,
              "op4_chats": CHATS, "op6_mix": MIX, "op8_jaccard": JACCARD,
              "op12_linedups": LINEDUPS, "op13_divergence": DIVERGENCE}
