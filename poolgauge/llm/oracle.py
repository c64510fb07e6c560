"""DuckDB SQL of the queries that SQL can express.

Language ID, token files, pseudonyms, fingerprints, byte-pair encoding and
WARC digests have no SQL; their tests compare with brute force.
"""

from __future__ import annotations

from poolgauge.llm import chat, quality

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_SAFE = "replace(coalesce({0}, '{1}'), '<|', '< |')"

# a turn without conv_id is a conversation of its own; of equal conversations one without conv_id comes last
OP1 = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS l FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT NULL, [struct_pack(turn := turn, role := role, text := text)] FROM t WHERE conv_id IS NULL),
k AS (SELECT l, min(conv_id) AS conv_id FROM c GROUP BY l),
p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(generate_series(1, len(l) - 1)) AS i FROM k WHERE len(l) > 1)),
m AS (SELECT row_number() OVER () AS r, conv_id, l, len(l) AS n_turns FROM k WHERE l NOT IN (SELECT l FROM p)),
s AS (SELECT r, conv_id, n_turns, i, e.turn // {chat.BLOCK_TURNS} AS b, '{chat.OPEN}' || {_SAFE.format("e.role", "unknown")} || chr(10) || {_SAFE.format("e.text", "")} || '{chat.CLOSE}' || chr(10) AS said
  FROM (SELECT r, conv_id, n_turns, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM m))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY r ORDER BY b) - 1 AS BIGINT) AS part, CAST(n_turns AS BIGINT) AS n_turns, string_agg(said, '' ORDER BY i) AS text
FROM s GROUP BY r, conv_id, n_turns, b
"""

OP8 = f"""
WITH lines AS (
  SELECT row AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_A_Z}) AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM keyed k LEFT JOIN firsts f ON f.key = k.key AND length(k.key) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS gram FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2, 3, 4]) AS k FROM h) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE length(trim(line, {_SPACE})) > 0 GROUP BY r),
m AS (SELECT d.r, d.doc_id, d.stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(text, '\\p{{Lu}}')) AS BIGINT) AS n_capitals,
    coalesce(ln.n_lines, 0) AS n_lines, coalesce(ln.n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    least(1000, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0)) AS symbols, least(1000, coalesce(1000 * n_capitals // nullif(word_chars, 0), 0)) AS capitals,
    least(1000, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0)) AS dup_lines, least(1000, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)) AS repeats FROM m),
known AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT b.*, good FROM b JOIN known USING (doc_id) WHERE NOT base_failed),
passed AS ({" UNION ALL ".join(f"SELECT stratum, '{x}' AS rule, {x} AS score FROM b WHERE NOT base_failed" for x in quality.RULES)}),
share AS (SELECT stratum, rule, score, (SELECT count(*) FROM passed o WHERE o.stratum = p.stratum AND o.rule = p.rule AND o.score >= p.score) AS above, (SELECT count(*) FROM passed o WHERE o.stratum = p.stratum AND o.rule = p.rule) AS every
  FROM (SELECT DISTINCT stratum, rule, score FROM passed) p),
lev AS (SELECT stratum, rule, score, CAST(ceil(1000.0 * above / every) AS BIGINT) AS level FROM share),
text_level AS (SELECT lab.stratum, lab.good, least({", ".join(f"l_{x}.level" for x in quality.RULES)}) AS level FROM lab {" ".join(f"JOIN lev l_{x} ON l_{x}.stratum = lab.stratum AND l_{x}.rule = '{x}' AND l_{x}.score = lab.{x}" for x in quality.RULES)}),
goods AS (SELECT stratum, count(*) FILTER (WHERE good) AS n, (SELECT count(DISTINCT stratum) FROM text_level) AS tests FROM text_level GROUP BY stratum),
curve AS (SELECT t.stratum, t.level, count(*) FILTER (WHERE o.good) AS k, count(*) FILTER (WHERE NOT o.good) AS hit FROM (SELECT DISTINCT stratum, level FROM text_level) t JOIN text_level o ON o.stratum = t.stratum AND o.level <= t.level GROUP BY t.stratum, t.level),
terms AS (SELECT stratum, n, tests, j, exp(lgamma(n + 1) - (CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END) - (CASE WHEN n = j THEN 0 ELSE lgamma(n - j + 1) END) + j * ln({quality.ALPHA}) + (n - j) * ln(1 - {quality.ALPHA})) AS p
  FROM (SELECT stratum, CAST(n AS DOUBLE) AS n, tests, unnest(generate_series(0, CAST(ceil(n * {quality.ALPHA}) AS BIGINT))) AS j FROM goods WHERE n > 0)),
tails AS (SELECT stratum, tests, j, sum(p) OVER (PARTITION BY stratum ORDER BY j) AS tail FROM terms),
most AS (SELECT stratum, max(j) AS most FROM tails WHERE tail <= {quality.DELTA} / tests GROUP BY stratum),
best AS (SELECT stratum, arg_min(level, (k - hit, level)) AS up_to FROM curve JOIN most USING (stratum) WHERE k <= most AND hit > k AND level < 1000 GROUP BY stratum),
cut AS (SELECT stratum, {", ".join(f"max(score) FILTER (WHERE rule = '{x}') AS c_{x}" for x in quality.RULES)} FROM lev JOIN best USING (stratum) WHERE level > up_to GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"NOT coalesce({x} > c_{x}, false)" for x in quality.RULES)} AS kept
FROM b LEFT JOIN cut USING (stratum)
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), {0}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_A_Z)

OP10 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i+9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM items WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, array_to_string(ws[i:i+n-1], ' ') AS g FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d JOIN sizes ON len(ws) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win ON win.n = dw.n AND win.g = dw.g),
words AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS w FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""

SQL: dict[str, str] = {"op1_chat_format": OP1, "op8_line_dedup": OP8, "op9_quality": OP9, "op10_decontaminate": OP10}
