"""DuckDB SQL for the queries that SQL can express."""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 15) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS cap FROM r),
x AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
             / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
      FROM x WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (ratio, rank)) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.source, source_size, least(CAST(cap AS DOUBLE), f.level * weight) AS target FROM l CROSS JOIN f),
v AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
c AS (SELECT d.*, v.source_size, v.target, v.whole, target - whole * v.source_size AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
e AS (SELECT *, before <= budget AS inside, lead(before) OVER (PARTITION BY source ORDER BY key, doc_id, before) AS after FROM c)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN whole < 3 AND inside AND ((after IS NOT NULL AND after <= budget) OR (budget - before) * 2 > size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM e
"""

OP10 = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b(word) AS (VALUES ('spam'), ('casino'), ('porn'), ('xxx'), ('warez'), ('viagra')),
q AS (SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path),
w AS (SELECT page_id, max(word) AS word FROM p JOIN b ON regexp_matches(host || path, '(^|[^A-Za-z0-9])' || word || '([^A-Za-z0-9]|$)') GROUP BY page_id)
SELECT q.page_id, host, path, rule, coalesce(rverdict, CASE WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN 'word:' || word END AS word_rule
FROM q LEFT JOIN w USING (page_id)
"""

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.a LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 'g': array_to_string(w[i:i + 12], ' ')})) AS u FROM w WHERE len(w) >= 13),
f AS (SELECT u.g AS g, min(doc_id) AS m FROM s GROUP BY 1),
r AS (SELECT DISTINCT s.doc_id, unnest(range(s.u.i, s.u.i + 13)) AS p FROM s JOIN f ON s.u.g = f.g WHERE f.m < s.doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM x ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

OP12 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""

#: The crc32 goes by half bytes; its 16 remainders are fixed values.
OP13 = r"""
WITH RECURSIVE c AS (
  SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS s,
         [%s] AS r FROM documents),
x AS (
  SELECT *, list_reduce(flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(s[i]) AS BIGINT), 0])),
         lambda a, b: xor(r[(xor(a, b) & 15) + 1], xor(a, b) >> 4), 4294967295) & 1 AS odd FROM c),
y AS (SELECT *, CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS changed,
             concat_ws('', coalesce(octet_length(encode(s)) || ':' || s, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                       coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
                       coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head FROM x),
z AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS forged FROM y),
l AS (SELECT *, row_number() OVER (ORDER BY doc_id, leaf) AS id, dense_rank() OVER (ORDER BY source COLLATE "C" NULLS FIRST) - 1 AS t,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM z),
nodes(lvl, t, i, n, h) AS (
  SELECT 0, t, i, n, leaf FROM l
  UNION ALL SELECT lvl + 1, t, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lvl, t, i // 3, n),
subroots AS (SELECT t, h FROM nodes WHERE n = 1),
top(lvl, i, n, h) AS (
  SELECT 0, t, (SELECT count(*) FROM subroots), h FROM subroots
  UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3, n),
every AS (SELECT 0 AS kind, * FROM nodes UNION ALL SELECT 1, lvl, 0, i, n, h FROM top),
s AS (SELECT a.kind, a.lvl, a.t, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
      FROM every a JOIN every b ON a.kind = b.kind AND a.lvl = b.lvl AND a.t = b.t AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.kind, a.lvl, a.t, a.i),
low(id, lvl, t, i, h, proof) AS (
  SELECT id, 0, t, i, forged, '' FROM l
  UNION ALL SELECT id, w.lvl + 1, w.t, w.i // 3, sha256(before || h || after), proof || before || after FROM low w JOIN s ON s.kind = 0 AND s.lvl = w.lvl AND s.t = w.t AND s.i = w.i),
mid AS (SELECT id, t, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM low GROUP BY id, t),
high(id, lvl, i, h, proof) AS (
  SELECT id, 0, t, h, proof FROM mid
  UNION ALL SELECT id, w.lvl + 1, w.i // 3, sha256(before || h || after), proof || before || after FROM high w JOIN s ON s.kind = 1 AND s.lvl = w.lvl AND s.i = w.i),
done AS (SELECT id, arg_max(h, lvl) AS folded, arg_max(proof, lvl) AS proof FROM high GROUP BY id),
root AS (SELECT h FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, subroots.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM l JOIN subroots ON l.t = subroots.t JOIN done ON l.id = done.id CROSS JOIN root
""" % (
    "0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108"
)

ORACLES = {"op12_exact_dedup": OP12, "op13_merkle_manifest": OP13, "op9_cover_dedup": OP9, "op3_minhash": OP3, "op2_near_vectors": OP2, "op4_mixing": OP4, "op10_url_filter": OP10}
