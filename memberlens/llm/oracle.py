"""SQL for DuckDB that says the same as the queries, written apart from them."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}

STATEMENTS["op2_grace_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM d
WINDOW same AS (PARTITION BY body)
"""

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STATEMENTS["op8_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM d
),
k AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM l),
common AS (
  SELECT key, max(doc_id) AS stays_in FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT k.*, (c.stays_in IS NOT NULL AND k.doc_id <> c.stays_in) AS goes
  FROM k LEFT JOIN common c USING (key)
)
SELECT doc_id,
       count(*) AS n_lines,
       count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

STATEMENTS["op9_systematic_mix"] = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', 'mix', doc_id, md5(text))) AS draw
  FROM documents
),
c AS (
  SELECT *, greatest(length(bin(size)) - 4, 0) AS low FROM d
),
s AS (
  SELECT src, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY src
),
total AS (SELECT 1.5 * sum(source_size) AS words FROM s),
level(step, cut, height) AS (
  SELECT 0, 0::BIGINT, (SELECT words FROM total) / sum(weight) FROM s
  UNION ALL
  SELECT l.step + 1, n.cut, n.height
  FROM level l, LATERAL (
    SELECT count(*) FILTER (weight * l.height > 2.0 * source_size) AS cut,
           ((SELECT words FROM total)
             - coalesce(sum(2.0 * source_size) FILTER (weight * l.height > 2.0 * source_size), 0))
           / sum(weight) FILTER (NOT weight * l.height > 2.0 * source_size) AS height
    FROM s
  ) n
  WHERE n.cut > l.cut
),
top AS (SELECT height FROM level ORDER BY step DESC LIMIT 1),
t AS (
  SELECT src, source_size,
         CASE WHEN weight * height > 2.0 * source_size THEN 2.0 * source_size
              ELSE weight * height END AS target,
         floor(('0x' || substr(md5('mix:' || src), 1, 7))::BIGINT::DOUBLE / 268435456.0 * 1e9)::HUGEINT AS shift
  FROM s, top
),
walked AS (
  SELECT c.*, t.source_size, t.target, t.shift,
         floor(t.target / t.source_size * 1e9)::HUGEINT AS unit,
         row_number() OVER (PARTITION BY src ORDER BY low * 16 + (size >> low), draw)::HUGEINT AS nth
  FROM c JOIN t USING (src)
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * ((unit * nth + shift) // 1000000000 - (unit * (nth - 1) + shift) // 1000000000))::BIGINT AS taken
FROM walked
"""

STATEMENTS["op6_block_anchors"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM d WHERE len(ws) >= 35),
g AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS name FROM w),
r AS (SELECT doc_id, s FROM g QUALIFY count(*) OVER (PARTITION BY name) > 1),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM r)
SELECT d.doc_id,
       any_value(len(d.ws))::BIGINT AS n_words,
       count(gone.i)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(words.word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN words ON words.doc_id = d.doc_id
LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i
GROUP BY d.doc_id
"""

STATEMENTS["op5_sparse_product"] = rf"""
WITH RECURSIVE
d AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[s:s + 4], ' ')) AS name
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM d WHERE len(ws) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM g a JOIN g b ON a.name = b.name AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared >= 75 * (p.n + q.n - shared)
),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.seen
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(seen) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id)
GROUP BY d.doc_id
"""

STATEMENTS["op11_norm_buckets"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
whole AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS all_terms FROM d WHERE len(terms) > 0),
tf AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL
),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, whole GROUP BY term, n_docs
),
item AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
times AS (SELECT item_id, term, count(*) AS k FROM item GROUP BY ALL),
m AS (SELECT row, doc_id, 100 - 75 + ((75 * len(terms) * n_docs) // all_terms) AS m FROM d, whole),
scored AS (
  SELECT item_id, row, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM times JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (row)
  GROUP BY ALL
),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM scored JOIN d USING (row) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

STATEMENTS["op12_suffix_subtrees"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body
  FROM documents
),
p AS (SELECT row, lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p
),
grams AS (
  SELECT lang, k, array_to_string(list_slice(words, s, s + k - 1), ' ') AS phrase
  FROM w, range(1, 5) AS size(k), unnest(range(1, len(words) - k + 2)) AS start(s)
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 30),
inner_ AS (
  SELECT lang, array_to_string(list_slice(words, s, s + j - 1), ' ') AS phrase, max(a) AS longer
  FROM c, range(2, 4) AS size(j), unnest(range(1, k - j + 2)) AS start(s)
  WHERE j < k GROUP BY ALL
),
kept AS (
  SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
),
cuts AS (
  SELECT kept.lang, kept.phrase, a, cut, fl.f AS l, fr.f AS r,
         ((2000000 * a::HUGEINT) // (fl.f + fr.f))::BIGINT AS score
  FROM kept, unnest(range(1, kept.k)) AS place_(cut), f AS fl, f AS fr
  WHERE fl.lang = kept.lang AND fl.phrase = array_to_string(list_slice(words, 1, cut), ' ')
    AND fr.lang = kept.lang AND fr.phrase = array_to_string(list_slice(words, cut + 1, kept.k), ' ')
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts
),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)
  ) AS rank
  FROM best WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

STATEMENTS["op13_chunked_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (k // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31)::INT + 1, 1)), '') AS digest
  FROM p
)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
