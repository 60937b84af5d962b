"""DuckDB counterparts of the queries that SQL can express."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


CONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
items AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS win, least(13, len(w)) AS m
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM items WHERE len(w) > 0)
),
spots AS (
  SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
),
found AS (SELECT doc_id, item_id, spots.m, p FROM spots JOIN windows ON spots.win = windows.win AND spots.m = windows.m),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


_HEAD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
  || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
  || chr(13) || chr(10) || chr(13) || chr(10)"""

FIXITY = f"""
WITH records AS (
  SELECT page_id, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS lot, {_HEAD} AS head,
    coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS body
  FROM pages
)
SELECT page_id, CAST(strlen(head || body) AS BIGINT) AS length, CASE lot WHEN '00' THEN 'changed' ELSE 'missing' END AS status,
  sha256(head || body) AS hash_a, CASE lot WHEN '00' THEN sha256(head || '?' || substr(body, 2)) END AS hash_b
FROM records WHERE lot IN ('00', '01')
"""

# The fitting as a recursion over the cells: one margin at a time, 120 steps, far beyond convergence.
MIXING = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN regexp_matches(coalesce(text, ''), '(?i)licen[cs]e|copyright|all rights reserved') THEN 'license'
         WHEN regexp_matches(coalesce(text, ''), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_]|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}') THEN 'contact'
         WHEN regexp_matches(coalesce(text, ''), '[A-Za-z0-9_] \| [A-Za-z0-9_]') THEN 'table'
         WHEN regexp_matches(coalesce(text, ''), '[#*$%&]{3}') THEN 'marks' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents
),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL),
total AS (SELECT sum(tokens) AS t FROM cells),
aims AS (
  SELECT margin, value, p / sum(p) OVER (PARTITION BY margin) AS share FROM (
    SELECT 0 AS margin, source AS value, pow(sum(tokens), 0.7) AS p FROM cells GROUP BY source
    UNION ALL SELECT 1, lang, pow(sum(tokens), 0.7) FROM cells GROUP BY lang
    UNION ALL SELECT 2, topic, pow(sum(tokens), 0.5) FROM cells GROUP BY topic)
),
steps AS (
  SELECT 0 AS step, source, lang, topic, tokens, CAST(1 AS DOUBLE) AS weight FROM cells
  UNION ALL
  SELECT step + 1, source, lang, topic, tokens,
    weight * share * (SELECT t FROM total) / sum(tokens * weight) OVER (PARTITION BY CASE step % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END)
  FROM steps JOIN aims ON margin = step % 3 AND value = CASE step % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END
  WHERE step < 120
),
raked AS (SELECT source, lang, topic, weight, least(1.0, weight) AS probability FROM steps WHERE step = 120)
SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, round(greatest(1.0, weight), 6) AS sample_weight,
  CAST('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR)), 1, 12) AS UBIGINT) / 281474976710656.0 < probability AS sampled
FROM docs JOIN raked USING (source, lang, topic)
"""

# Bytes as pairs of hexadecimal digits: DuckDB has no substring of a BLOB.
SUFFIXES = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
grams AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM docs)),
firsts AS (SELECT g, min(doc_id) AS d FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)),
repeats AS (SELECT doc_id, p FROM grams JOIN firsts USING (g) WHERE doc_id > d),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= 50 THEN 0 ELSE 1 END AS opens FROM repeats WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
spans AS (
  SELECT doc_id, k, min(p) AS low, max(p) + 50 AS high
  FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked) GROUP BY doc_id, k
),
pieces AS (
  SELECT doc_id, h, n, coalesce(lag(high) OVER w, 0) AS a, low AS b FROM docs JOIN spans USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY low)
  UNION ALL
  SELECT doc_id, any_value(h), any_value(n), max(high), any_value(n) FROM docs JOIN spans USING (doc_id) GROUP BY doc_id
),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept_h FROM pieces GROUP BY doc_id),
sums AS (SELECT doc_id, sum(high - low) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept_h, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


def _table() -> list[int]:
    """The table of crc32 by its polynomial."""
    found = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        found.append(c)
    return found


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of ``text``, a byte at a time by the table ``t``."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS UINTEGER)"
    data = f"list_transform(range(strlen({text})), lambda i: {byte})"
    step = "xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UINTEGER), {data}), lambda c, b: {step}), CAST(4294967295 AS UINTEGER))"


_CRC_TABLE = f"crc_table AS (SELECT CAST({_table()} AS UINTEGER[]) AS t)"

# Near words by patterns: a replaced letter leaves the word around it, a lost one leaves another word of the list.
SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
),
hashed AS (SELECT run, k, {_crc32("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM runs, crc_table),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
),
holes AS (
  SELECT word, n, p, left(word, p) || '_' || substr(word, p + 2) AS replaced, left(word, p) || substr(word, p + 2) AS shorter
  FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)
),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.replaced = b.replaced AND a.p = b.p WHERE a.word <> b.word
  UNION SELECT w.word, h.word, h.n FROM words w JOIN holes h ON h.shorter = w.word
  UNION SELECT h.word, w.word, w.n FROM words w JOIN holes h ON h.shorter = w.word
),
best AS (
  SELECT word, n_near, top.other AS other, top.other_n AS other_n
  FROM (SELECT word, count(*) AS n_near, first(near ORDER BY other_n DESC, other) AS top FROM near GROUP BY word)
),
formed AS (
  SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
    CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, form AS led FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.led WHERE formed.form IS NOT NULL
),
ends AS (SELECT word, led FROM chain WHERE led NOT IN (SELECT word FROM formed WHERE form IS NOT NULL))
SELECT word, form, coalesce(led, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""

RESAMPLING = f"""
WITH {_CRC_TABLE},
found AS (
  SELECT 'S' AS side, doc_id, unnest({_words('text')}) AS word FROM documents
  UNION ALL SELECT 'T', NULL, unnest({_words('text')}) FROM benchmark
),
hashed AS (SELECT word, {_crc32('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM found), crc_table),
sums AS (SELECT bucket, count(*) FILTER (side = 'S') AS s, count(*) FILTER (side = 'T') AS t FROM found JOIN hashed USING (word) GROUP BY bucket),
whole AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS ss, CAST(coalesce(sum(t), 0) AS DOUBLE) AS tt FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM sums, whole),
weighed AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS BIGINT) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight
  FROM found JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'S' GROUP BY doc_id
),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS whole FROM scored WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * whole // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
