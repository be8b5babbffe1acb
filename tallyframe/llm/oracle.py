"""SQL for DuckDB that gives the same rows as the queries, where SQL can express them.

Tokenizers, learned models and bytes of texts are beyond it; the tests compare those
queries with brute force instead.
"""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP2 = rf"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words
  FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM texts WHERE len(words) >= 50)
), firsts AS (
  SELECT content, min(doc_id) AS least FROM windows GROUP BY content
), gone AS (
  SELECT DISTINCT doc_id, s + k AS i
  FROM (SELECT w.doc_id, w.s FROM windows w JOIN firsts f USING (content) WHERE f.least < w.doc_id), range(50) r(k)
), kept AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts) t
  ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.i = g.i
  GROUP BY t.doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, (len(t.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

OP5 = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_SPACE}'),
                             lambda x: x <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[s:s + 4], ' ')) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS s FROM texts WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE 100 * p.shared >= 75 * (x.n + y.n - p.shared)
), reached AS (
  SELECT doc_id, doc_id AS other FROM texts
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, t.doc_id = l.component_id AS kept
FROM texts t JOIN least l ON t.doc_id = l.doc_id LEFT JOIN sizes s ON t.doc_id = s.doc_id
"""

OP8 = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words
  FROM documents
), windows AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(words[s:s + 4], ' '))) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS s FROM texts WHERE len(words) >= 5)
), repeats AS (
  SELECT doc_id, count(DISTINCT s + k) AS n FROM windows, range(5) r(k) WHERE windows.n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY doc_id
), measured AS (
  SELECT t.doc_id, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(replace(text, '!', '')) AS n_marks,
         coalesce(l.n, 0) AS n_lines, coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN lines l ON t.doc_id = l.doc_id LEFT JOIN repeats r ON t.doc_id = r.doc_id
), judged AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END
           + CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END
           + CASE WHEN 100 * n_symbols > 25 * n_words THEN 16 ELSE 0 END
           + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END
           + CASE WHEN 100 * n_upper > 50 * word_chars THEN 64 ELSE 0 END
           + CASE WHEN 100 * n_marks > 50 * n_words THEN 128 ELSE 0 END)::BIGINT AS failed_bits
  FROM measured
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM judged
"""

OP11 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words
  FROM (SELECT lang, doc_id, unnest(parts) AS piece, unnest(range(len(parts))) AS p
        FROM (SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]') AS parts FROM documents))
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, m, array_to_string(words[s:s + m - 1], ' ') AS phrase
  FROM (SELECT lang, m, words, unnest(range(1, len(words) - m + 2)) AS s FROM pieces, range(1, 4) r(m) WHERE len(words) >= m)
), counted AS (
  SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY lang, phrase, m HAVING count(*) >= 10
), cuts AS (
  SELECT lang, phrase, f AS a, m, k, array_to_string(w[1:k], ' ') AS lft, array_to_string(w[k + 1:], ' ') AS rgt
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM counted), range(1, 3) r(k) WHERE k < m
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.k,
         ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.lft JOIN counted y ON y.lang = c.lang AND y.phrase = c.rgt
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, part, max(f) AS longer
  FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
        FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM counted WHERE m = 3))
  GROUP BY lang, part
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.part = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
)
SELECT k.lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k
JOIN totals t ON t.lang = k.lang WHERE rank <= 2000
"""

ORACLE_SQL = {"op2_substring_dedup": OP2, "op5_minhash": OP5, "op8_quality_rules": OP8, "op11_collocations": OP11}
