"""DuckDB SQL for the operators of this folder whose rows SQL can state.

Written from the definitions alone, with every pair and every window compared, so it
shares no step with the operators. It takes doc_id as unique and not null, as the tables
have it; rows that repeat are covered by the brute-force tests.
"""
from __future__ import annotations

#: Lower-cased A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = r"[^\x20\x09-\x0D]+"
_LETTER_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Sets of 5-word shingles, all pairs that share one, components by reachability.
NGRAM_JOIN = f"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANK_WORDS}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (
  SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * meets.n >= 75 * (x.n + y.n - meets.n)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
  SELECT a AS doc_id, b AS other FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""

#: Every window of every item against every run of as many words of every document.
DECONTAMINATE = f"""
WITH items AS (
  SELECT item_id, w, least(10, len(w)) AS size
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_LETTER_WORDS}') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_LETTER_WORDS}') AS w FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.size, p.i, v.item_id FROM places p JOIN windows v ON v.size = p.size AND v.g = p.g),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit h ON h.doc_id = w.doc_id LEFT JOIN named n ON n.doc_id = w.doc_id
"""

#: Every window of 20 words, ranked among its equals.
SUBSTRING_DEDUP = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK_WORDS}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
spread AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT s.doc_id, count(*) AS n, string_agg(s.word, ' ' ORDER BY s.p) AS t
  FROM spread s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p WHERE g.p IS NULL GROUP BY s.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

#: Distinct lines, all pairs that share a 10-character shingle, components by reachability.
LINE_DEDUP = """
WITH RECURSIVE
lines AS (
  SELECT doc_id, p, l, regexp_matches(l, '[^\\x20\\x09-\\x0D]') AS worded
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS l
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
named AS (SELECT l, row_number() OVER (ORDER BY min(doc_id), arg_min(p, (doc_id, p))) AS line FROM lines WHERE worded GROUP BY l),
shingles AS (
  SELECT DISTINCT line, substr(l, i, 10) AS s
  FROM (SELECT line, l, unnest(range(1, greatest(length(l) - 8, 2))) AS i FROM named)),
sizes AS (SELECT line, count(*) AS n FROM shingles GROUP BY line),
meets AS (
  SELECT a.line AS a, b.line AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.line < b.line GROUP BY a.line, b.line),
linked AS (
  SELECT a, b FROM meets JOIN sizes x ON x.line = a JOIN sizes y ON y.line = b
  WHERE 4 * meets.n >= 3 * (x.n + y.n - meets.n)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
  SELECT a AS line, b AS other FROM edges
  UNION
  SELECT r.line, e.b FROM reach r JOIN edges e ON e.a = r.other),
roots AS (SELECT n.l, least(n.line, coalesce(min(r.other), n.line)) AS root FROM named n LEFT JOIN reach r ON r.line = n.line GROUP BY n.l, n.line),
judged AS (
  SELECT lines.doc_id, lines.p, lines.l, worded, worded AND row_number() OVER (PARTITION BY root, worded ORDER BY doc_id, p) > 1 AS gone
  FROM lines LEFT JOIN roots ON worded AND roots.l = lines.l),
found AS (
  SELECT doc_id, count_if(worded) AS n, count_if(gone) AS removed, string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone) AS t
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(f.removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(f.t, '') END AS kept_text
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
"""

#: zlib's crc32 of a text of ASCII characters, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

#: Every period against every place; a stretch that lies in one of a smaller period is no run of its own.
PERIODIC_RUNS = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK_WORDS}') AS w, {_CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
marks AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS told, h // 10 AS g FROM texts),
cuts AS (SELECT *, CASE WHEN told THEN g % n END AS a FROM marks),
steps AS (SELECT *, CASE WHEN told THEN 1 + (n - a) // (3 + g % 8) END AS p FROM cuts),
words AS (
  SELECT doc_id, i, w[CASE WHEN told AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM steps)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
long AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM islands
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM long r WHERE NOT EXISTS (
    SELECT 1 FROM long s WHERE s.doc_id = r.doc_id AND s.period < r.period AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
told AS (
  SELECT doc_id, count(*) AS n, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS t,
         arg_max((start, length, period), (length / period, -start, -period)) AS best FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t
  FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_runs, CAST(t.best[1] AS BIGINT) AS start, CAST(t.best[2] AS BIGINT) AS length, CAST(t.best[3] AS BIGINT) AS period,
       CAST(1000 * t.best[2] // t.best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(t.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

ORACLES = {"op4_ngram_join": NGRAM_JOIN, "op6_decontaminate": DECONTAMINATE, "op8_substring_dedup": SUBSTRING_DEDUP,
           "op9_line_dedup": LINE_DEDUP, "op12_periodic_runs": PERIODIC_RUNS}
