"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# Every window of 10 words of an item (a shorter item whole), as text; document words inside an occurrence are hit.
DECONTAMINATION = r"""
WITH item_words AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
doc_windows AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM doc_words, (SELECT DISTINCT n FROM item_windows) lengths WHERE len(w) >= n)),
found AS (SELECT r, p, n, item FROM doc_windows JOIN item_windows USING (n, win)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit
        FROM (SELECT r, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

TOP_K = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

CHAT = r"""
WITH said AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
numbered AS (
  SELECT *, CAST(turn // 64 AS BIGINT) AS part, row_number() OVER (
    PARTITION BY conv_id, turn // 64 ORDER BY turn, role NULLS FIRST, text NULLS FIRST) - 1 AS nr FROM said),
cut AS (SELECT *, CASE WHEN part IS NULL THEN nr ELSE nr // 256 END AS piece FROM numbered),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role IS NOT NULL AND role <> 'system'),
rendered AS (
  SELECT s.conv_id, p.perspective, s.part, s.piece, s.nr, coalesce(s.role = p.perspective, false) AS own,
         '<|im_start|>' || CASE WHEN s.role = p.perspective THEN 'assistant' WHEN s.role = 'system' THEN 'system'
           ELSE 'user' || coalesce(' name=' || replace(s.role, '<|im_', '<| im_'), '') END || chr(10) AS head,
         replace(coalesce(s.text, ''), '<|im_', '<| im_') || '<|im_end|>' AS body
  FROM cut s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, perspective, part, piece ORDER BY nr ROWS UNBOUNDED PRECEDING) AS upto
  FROM rendered)
SELECT conv_id, perspective, part, CAST(piece AS BIGINT) AS piece,
       CAST(count(*) AS INTEGER) AS n_messages, CAST(count(*) FILTER (WHERE own) AS INTEGER) AS n_own,
       string_agg(head || body || chr(10), '' ORDER BY nr) AS text,
       coalesce(string_agg(CAST(upto - 1 - length(body) AS BIGINT) || '-' || CAST(upto - 1 AS BIGINT), ','
                           ORDER BY nr) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part, piece
"""

MIX = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents),
keyed AS (
  SELECT *, CAST('0x' || substr(ord, 1, 8) AS BIGINT)
            % (SELECT greatest(128, CAST(ceil(count(*) / 50000.0) AS BIGINT)) FROM sized) AS shard
  FROM sized),
cells AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS words,
         CAST(CASE WHEN sum(size) > 0 THEN greatest(1, floor(sum(size) / 64.0 + 0.5)) ELSE 0 END AS BIGINT) AS blocks
  FROM keyed GROUP BY source, shard),
sources AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS source_size, CAST(sum(blocks) AS BIGINT) AS all_blocks,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos
  FROM cells GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][pos % 3 + 1] AS weight FROM sources),
levels AS (
  SELECT *, 3 * source_size / weight AS full_at, row_number() OVER w AS rank,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW w AS (ORDER BY 3 * source_size / weight, pos)),
opened AS (SELECT min(rank) AS r, arg_min(level, rank) AS l FROM levels WHERE full_at >= level),
targets AS (
  SELECT v.*, CASE WHEN rank < r THEN CAST(3 * source_size AS DOUBLE)
              ELSE least(l * weight, CAST(3 * source_size AS DOUBLE)) END AS target
  FROM levels v, opened),
votes AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size * all_blocks ELSE 0 END AS votes FROM targets),
bounds AS (
  SELECT *, CAST(greatest(0, floor(votes - slack)) AS BIGINT) AS least_seats, CAST(ceil(votes + slack) AS BIGINT) AS up
  FROM (SELECT *, CASE WHEN sum(votes) OVER () > 0 THEN votes / sum(votes) OVER () ELSE 0 END
                  * count(*) OVER () / 2 + 1 AS slack FROM votes)),
quotients AS (
  SELECT source, pos, least_seats, CAST(round(sum(votes) OVER () ) AS BIGINT) - sum(least_seats) OVER () AS open_seats,
         votes, up FROM bounds),
contest AS (
  SELECT pos, least_seats, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, pos, k) <= open_seats AS won
  FROM (SELECT *, unnest(range(least_seats, up + 1)) AS k FROM quotients)),
seats AS (
  SELECT t.source, t.source_size, t.target, t.all_blocks, least(s.seats, 3 * t.all_blocks) AS seats
  FROM targets t JOIN (SELECT pos, any_value(least_seats) + count(*) FILTER (WHERE won) AS seats
                       FROM contest GROUP BY pos) s USING (pos)),
dealt AS (
  SELECT c.*, s.source_size, s.target,
         CAST(floor(CASE WHEN all_blocks > 0 THEN seats / all_blocks ELSE 0 END * upto + 0.5)
              - floor(CASE WHEN all_blocks > 0 THEN seats / all_blocks ELSE 0 END * (upto - blocks) + 0.5) AS BIGINT) AS quota
  FROM (SELECT *, sum(blocks) OVER (PARTITION BY source ORDER BY shard) AS upto FROM cells) c
  JOIN seats s ON c.source IS NOT DISTINCT FROM s.source),
cut AS (
  SELECT *, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS times,
         CASE WHEN blocks > 0 THEN CAST(floor((quota - quota // blocks * blocks) * words / blocks) AS BIGINT) ELSE 0 END AS cut_at
  FROM dealt),
placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY ord, id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_at
  FROM keyed)
SELECT doc_id, size, source_size, target,
       CAST(times * size + greatest(0, least(end_at, cut_at) - (end_at - size)) AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN times + CAST(end_at - size + size // 2 < cut_at AS INTEGER) ELSE 0 END AS INTEGER) AS copies
FROM placed p JOIN cut c ON p.shard = c.shard AND p.source IS NOT DISTINCT FROM c.source
"""


def centroid_rounds(k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3) -> str:
    """Plain rounds, one set of common table expressions each."""
    parts = [f"""
raw AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (
  SELECT r, vec_id, unnest(range({dims})) AS d,
         CAST(unnest(list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE)))) AS BIGINT) AS x FROM raw),
firsts AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM raw
  QUALIFY c < {k}),
m0 AS MATERIALIZED (SELECT c, d, x FROM firsts JOIN v USING (r))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, c, far FROM (SELECT v.r, m.c, sum((v.x - m.x) * (v.x - m.x)) AS far FROM v JOIN m{i} m USING (d) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, c) = 1)""")
        if i < rounds:
            # a floor division: // cuts towards zero
            parts.append(f"""
m{i + 1} AS MATERIALIZED (
  SELECT m.c, m.d, CASE WHEN s.n IS NULL THEN m.x ELSE (s.total - ((s.total % s.n) + s.n) % s.n) // s.n END AS x
  FROM m{i} m LEFT JOIN (SELECT c, d, sum(x) AS total, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY c, d) s USING (c, d))""")
    return f"""
WITH {",".join(parts)},
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance,
       CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia,
       centroid_sha256
FROM a{rounds} JOIN raw USING (r) JOIN digests USING (c)
"""


COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
cut AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS tail
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
best AS (
  SELECT cut.lang, cut.phrase, cut.k, cut.a, c, x.a AS l, y.a AS r, (2000000 * cut.a) // (x.a + y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS s
        FROM (SELECT lang, a, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) AS rank
      FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * best.a)
JOIN totals USING (lang) WHERE rank <= 2000
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE
rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
texts AS (
  SELECT row_number() OVER () AS t, copies, least_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, text
  FROM (SELECT text, count(*) AS copies, min(doc_id) AS least_id FROM rows WHERE text IS NOT NULL GROUP BY text)),
grams AS MATERIALIZED (
  SELECT DISTINCT t, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT t, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM texts WHERE len(w) > 0)),
sizes AS (SELECT t, count(*) AS n FROM grams GROUP BY t),
common AS (SELECT a.t AS a, b.t AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.t < b.t GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE 10 * shared >= 8 * (x.n + y.n - shared)),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS t, a AS u FROM edges UNION SELECT reach.t, edges.b FROM reach JOIN edges ON edges.a = reach.u),
classes AS (SELECT reach.t, min(least_id) AS class_id FROM reach JOIN texts ON texts.t = reach.u GROUP BY reach.t),
links AS (SELECT a AS t, sum(copies) AS n FROM edges JOIN texts ON texts.t = b GROUP BY a)
SELECT rows.doc_id, CASE WHEN rows.text IS NULL THEN rows.doc_id ELSE coalesce(classes.class_id, least_id) END AS class_id,
       CAST(CASE WHEN rows.text IS NULL THEN 0 ELSE copies - 1 + coalesce(links.n, 0) END AS BIGINT) AS n_links
FROM rows LEFT JOIN texts USING (text) LEFT JOIN classes USING (t) LEFT JOIN links USING (t)
"""

REPEATED_WORDS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS MATERIALIZED (
  SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS place
  FROM windows JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t FROM words ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

# Bytes as pairs of hexadecimal digits.
REPEATED_BYTES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS MATERIALIZED (
  SELECT r, p, md5(substr(x, 2 * p + 1, 400)) AS h
  FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS p FROM d WHERE len(x) >= 400)),
starts AS (SELECT r, p FROM windows JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)),
numbered AS (
  SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run
  FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM starts)),
runs AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, run),
pieces AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS begin, a AS stop FROM runs
  UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
kept AS (
  SELECT r, string_agg(substr(x, 2 * begin + 1, CASE WHEN stop IS NULL THEN len(x) ELSE 2 * (stop - begin) END), '' ORDER BY begin) AS y
  FROM pieces JOIN d USING (r) GROUP BY r),
totals AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN totals USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_perspective_chat": CHAT,
    "op5_minhash_jaccard_join": NEAR_DUPLICATES,
    "op6_kd_tree_top_k": TOP_K,
    "op7_winnowing_decontamination": DECONTAMINATION,
    "op9_sainte_lague_mix": MIX,
    "op10_doubling_substring_dedup": REPEATED_WORDS,
    "op11_heap_centroids": centroid_rounds(),
    "op12_multikey_collocations": COLLOCATIONS,
    "op13_induced_suffix_dedup": REPEATED_BYTES,
}
