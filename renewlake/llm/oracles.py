"""The same results as DuckDB SQL, where SQL can say them and whole tables are not too slow."""

ORACLES = {}

ORACLES["op1_source_mixing"] = """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source
), rates AS (
  SELECT source, w / (SELECT sum(w) FROM sizes) * (SELECT sum(n) FROM sizes) * 1.0 / n AS rate FROM sizes
), cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
), units AS (
  SELECT doc_id, source, text,
    (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), counts AS (
  SELECT units.doc_id, units.source, units.text, cdf.rate, count(*) AS n
  FROM units JOIN cdf ON units.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= units.u
  GROUP BY units.doc_id, units.source, units.text, cdf.rate
), copies AS (
  SELECT doc_id, source, text, rate, unnest(range(1, n + 1)) AS copy FROM counts
)
SELECT doc_id, source, round(rate, 6) AS rate, copy::BIGINT AS copy,
  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key, text
FROM copies
"""

ORACLES["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), heavy AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.doc_id, line, pos, heavy.key IS NOT NULL AND heavy.holder <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN heavy ON keyed.key = heavy.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op4_exact_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op12_collocations"] = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), runs AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS k))
), f AS (
  SELECT lang, k, phrase, count(*) AS c FROM runs GROUP BY ALL HAVING count(*) >= 10
), totals AS (
  SELECT lang, count(*) AS n FROM runs WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT lang, k, phrase, c AS a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') AS tail
  FROM f, (SELECT unnest([1, 2]) AS cut) WHERE cut < k
), scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, x.c AS l, y.c AS r,
    ((1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), held AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase, max(c) AS longer
  FROM f, (SELECT unnest([1, 2]) AS i) WHERE k = 3 GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN held ON held.lang = lowest.lang AND held.phrase = lowest.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

ORACLES["op7_ngram_join"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w
  FROM documents
), words AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM worded
), runs AS (
  SELECT doc_id, n, pos, word, lead(word) OVER following AS second, lead(word, 2) OVER following AS third
  FROM words WINDOW following AS (PARTITION BY doc_id ORDER BY pos)
), sets AS (
  SELECT DISTINCT doc_id, concat_ws(' ', word, second, third) AS shingle FROM runs
  WHERE third IS NOT NULL OR (n < 3 AND pos = 1)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT documents.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(documents.doc_id, least.b) AS component_id
FROM documents LEFT JOIN sizes ON sizes.doc_id = documents.doc_id LEFT JOIN least ON least.a = documents.doc_id
"""

ORACLES["op10_substring_dedup"] = r"""
WITH worded AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), words AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM worded
), windows AS (
  SELECT doc_id, pos, word, CASE WHEN pos + 49 <= n THEN md5(string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS run
  FROM words
), firsts AS (
  SELECT run, min(doc_id) AS holder FROM windows WHERE run IS NOT NULL GROUP BY run
), judged AS (
  SELECT windows.doc_id, pos, word, coalesce(max(holder < windows.doc_id) OVER (
    PARTITION BY windows.doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), FALSE) AS gone
  FROM windows LEFT JOIN firsts ON firsts.run = windows.run
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS text
  FROM judged GROUP BY doc_id
)
SELECT worded.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM worded LEFT JOIN kept ON kept.doc_id = worded.doc_id
"""
