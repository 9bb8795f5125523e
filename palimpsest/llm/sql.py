"""SQL that gives the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations

#: A-Z become a-z, and nothing else does.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of the contracts on phrases: ASCII letters and digits and everything beyond ASCII.
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NGRAM_JACCARD = rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]) END AS shingles FROM w),
k AS (SELECT r, doc_id, len(shingles) AS n, array_to_string(list_sort(shingles), chr(10)) AS whole, shingles FROM s),
c AS (SELECT whole, min(doc_id) AS representative, any_value(n) AS n, any_value(shingles) AS shingles, row_number() OVER (ORDER BY min(doc_id)) AS class FROM k WHERE n > 0 GROUP BY whole),
x AS (SELECT class, n, unnest(shingles) AS shingle FROM c),
p AS (SELECT a.class AS a, b.class AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.class <> b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
t AS (SELECT class AS a, class AS b FROM c UNION SELECT t.a, p.b FROM t JOIN p ON p.a = t.b),
g AS (SELECT t.a AS class, min(c.representative) AS component FROM t JOIN c ON c.class = t.b GROUP BY t.a)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE g.component END AS component_id, CASE WHEN k.n = 0 THEN k.doc_id ELSE c.representative END AS representative
FROM k LEFT JOIN c USING (whole) LEFT JOIN g USING (class)"""

SUFFIX_DEDUP = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS raw FROM documents),
n AS (SELECT r, doc_id, raw, length(raw) // 2 AS n_bytes FROM d),
w AS (SELECT r, doc_id, i, md5(substr(raw, 2 * i + 1, 100)) AS passage FROM n, unnest(range(0, greatest(n_bytes - 49, 0))) AS u(i)),
f AS (SELECT passage, min(doc_id) AS first FROM w GROUP BY passage),
hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w JOIN f USING (passage) WHERE doc_id > first),
runs AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hits),
spans AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY r, run),
gaps AS (SELECT r, run, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY run) AS a, a AS b FROM spans),
tails AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM spans GROUP BY r),
kept AS (SELECT g.r, string_agg(substr(n.raw, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.run) AS head FROM gaps g JOIN n USING (r) GROUP BY g.r)
SELECT n.doc_id, CAST(n.n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
       sha256(from_hex(concat(coalesce(k.head, ''), substr(n.raw, 2 * CAST(coalesce(t.last, 0) AS BIGINT) + 1)))) AS kept_sha256
FROM n LEFT JOIN tails t USING (r) LEFT JOIN kept k USING (r)"""

DECONTAMINATION = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS words FROM benchmark),
v AS (SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[k:k + 9], ' ') AS phrase FROM i, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS u(k) WHERE len(words) > 0),
z AS (SELECT DISTINCT size FROM v),
o AS (SELECT d.r, z.size, k AS start, array_to_string(d.words[k:k + z.size - 1], ' ') AS phrase FROM d, z, unnest(range(1, greatest(0, len(d.words) - z.size + 1) + 1)) AS u(k)),
h AS (SELECT DISTINCT o.r, o.start, o.size, v.item FROM o JOIN v ON v.size = o.size AND v.phrase = o.phrase),
b AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(start, start + size)) AS place FROM h) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(b.n_hit, 0) AS n_hit, coalesce(g.n_items, 0) AS n_items, sha256(coalesce(g.items, '')) AS items_sha256, coalesce(b.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN b USING (r) LEFT JOIN g USING (r)"""

LICENSE_BASE = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
f AS (SELECT * FROM (VALUES ('under the mit license', 4, 'mit'), ('apache license version 2', 4, 'apache-2'), ('cc by nc', 3, 'cc-by-nc')) AS p(phrase, size, label)),
m AS (SELECT d.r, k - 1 AS start, f.label FROM d, f, unnest(range(1, greatest(0, len(d.words) - f.size + 1) + 1)) AS u(k) WHERE array_to_string(d.words[k:k + f.size - 1], ' ') = f.phrase)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, count(m.r) AS n_base, min(m.start) AS first_word, max(m.start) AS last_word, coalesce(string_agg(DISTINCT m.label, ',' ORDER BY m.label), '') AS base_labels
FROM d LEFT JOIN m USING (r) GROUP BY d.r, d.doc_id, d.words"""

TIFF_PAYLOAD = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS raw FROM documents),
n AS (SELECT r, doc_id, length(raw) // 2 AS n_bytes, greatest(1, (length(raw) // 2 + 63) // 64) * 64 AS size, raw FROM d),
p AS (SELECT r, doc_id, n_bytes, size, concat(raw, repeat('00', CAST(size - n_bytes AS BIGINT))) AS payload FROM n)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(from_hex(payload)) AS payload_sha256 FROM p"""

BLOCK_DEDUP = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS passage FROM d, unnest(range(1, greatest(len(words) - 11, 1))) AS u(i)),
f AS (SELECT passage, min(doc_id) AS first FROM w GROUP BY passage),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM w JOIN f USING (passage) WHERE doc_id > first),
g AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
x AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d WHERE r IN (SELECT r FROM g)),
k AS (SELECT x.r, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN gone ON gone.r = x.r AND gone.i = x.i WHERE gone.r IS NULL GROUP BY x.r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(CASE WHEN g.r IS NULL THEN array_to_string(d.words, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)"""

PHRASES = rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM t, unnest(t.pieces) AS u(piece)),
w AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase FROM p, unnest(range(1, 6)) AS a(size), unnest(range(1, greatest(len(words) - size + 2, 1))) AS b(i)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM w GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size >= 2),
k AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM c, unnest(range(1, c.size)) AS u(k), f x, f y, n WHERE x.lang = c.lang AND y.lang = c.lang AND n.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ') AND y.phrase = array_to_string(c.words[k + 1:], ' ')),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS turn FROM k) WHERE turn = 1),
i AS (SELECT DISTINCT m.lang, m.phrase FROM m JOIN c ON c.lang = m.lang AND c.a = m.a AND contains(' ' || c.phrase || ' ', ' ' || m.phrase || ' ') AND length(c.phrase) > length(m.phrase)),
o AS (SELECT m.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM m ANTI JOIN i USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000"""

#: The CRC-32 of a text of ASCII characters.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"

TRIE = rf"""WITH o AS (SELECT conv_id, list(concat(length(coalesce(role, '')), ':', coalesce(role, ''), length(coalesce(text, '')), ':', coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
      list(strlen(coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS sizes FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM o),
b AS (SELECT h.conv_id, CASE WHEN h.conv_id % 5 = 0 THEN h.turns ELSE list_concat(coalesce(x.turns[1:h.h], []), h.turns[h.h + 1:]) END AS turns,
      CASE WHEN h.conv_id % 5 = 0 THEN h.sizes ELSE list_concat(coalesce(x.sizes[1:h.h], []), h.sizes[h.h + 1:]) END AS sizes FROM h LEFT JOIN o x ON x.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS whole, d AS depth, sha256(array_to_string(turns[1:d], '|')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(turns[1:d - 1], '|')) END AS parent, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
      FROM b, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (SELECT depth, node, any_value(parent) AS parent, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN whole = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM p GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
s AS (SELECT up.depth, up.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved FROM n LEFT JOIN k USING (depth, node)
      JOIN p own ON own.conv_id = n.conv_id AND own.depth = n.depth JOIN p up ON up.conv_id = own.conv_id AND up.depth <= own.depth GROUP BY up.depth, up.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s USING (depth, node) LEFT JOIN k USING (depth, node) LEFT JOIN n q ON q.depth = n.depth - 1 AND q.node = n.parent"""
