"""DuckDB SQL for the queries that SQL can express.

White space and words are those of the contracts; RE2 classes are spelled out.  Digests and
sketches are replaced by the values themselves.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

# Links by counting shared shingles (only shingles that two sets hold are joined), components
# by following links to a fixed point.
SQL["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[]
                      ELSE list_distinct(list_transform(range(1, greatest(1, len(words) - 4) + 1),
                                                        lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
shared AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM (SELECT * FROM e SEMI JOIN shared USING (x)) a JOIN (SELECT * FROM e SEMI JOIN shared USING (x)) b USING (x)
  WHERE a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
reach AS (SELECT doc_id AS u, doc_id AS v FROM g UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, g.doc_id = component_id AS kept
FROM g JOIN c USING (doc_id)
"""

# Units are the sentences of lines; of equal ones the earliest (doc_id, start) stays, and runs of
# neighbouring others of 25 words or more go.  A line of which nothing is left goes with its end,
# so texts are put together again line by line.
SQL["op4_substring_dedup"] = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k,
         unnest(list_transform(range(1, len(lines) + 1),
                               lambda i: CAST(coalesce(list_sum(list_transform(lines[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT))) AS s
  FROM l),
c AS (
  SELECT doc_id, k, s, line, regexp_extract_all(line, '[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09-\x0D]+)*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS parts
  FROM u),
p AS (
  SELECT doc_id, k, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS j,
         s + unnest(list_transform(range(1, len(parts) + 1),
                                   lambda i: CAST(coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS b
  FROM c),
n AS (
  SELECT doc_id, k, j, part, b, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS pos,
         regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM p),
r AS (
  SELECT *, len(words) AS w, first_value(doc_id) OVER same AS kept_doc_id, first_value(b) OVER same AS kept_start, row_number() OVER same AS place
  FROM n WINDOW same AS (PARTITION BY words ORDER BY doc_id, b)),
x AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r WHERE place > 1),
g AS (SELECT * FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id, run) AS together FROM x) WHERE together >= 25),
removed AS (
  SELECT doc_id, string_agg(concat_ws(':', b, b + length(part), w, kept_doc_id, kept_start), ',' ORDER BY b) AS removed FROM g GROUP BY doc_id),
stay AS (
  SELECT n.doc_id, n.k, count(g.pos) AS gone, string_agg(n.part, '' ORDER BY n.j) FILTER (WHERE g.pos IS NULL) AS rest
  FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.pos = n.pos GROUP BY n.doc_id, n.k),
clean AS (
  SELECT c.doc_id, string_agg(CASE WHEN coalesce(gone, 0) = 0 THEN line ELSE rest END, chr(10) ORDER BY c.k)
           FILTER (WHERE coalesce(gone, 0) = 0 OR rest IS NOT NULL) AS left_text,
         last(coalesce(gone, 0) > 0 AND rest IS NULL ORDER BY c.k) AS last_gone, count(*) FILTER (WHERE coalesce(gone, 0) = 0 OR rest IS NOT NULL) AS n_left
  FROM c LEFT JOIN stay USING (doc_id, k) GROUP BY c.doc_id),
t AS (
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_text, '') || CASE WHEN last_gone AND n_left > 0 THEN chr(10) ELSE '' END END AS clean_text,
         coalesce(removed, '') AS removed
  FROM documents d LEFT JOIN clean USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT doc_id, clean_text, removed = '' OR coalesce(regexp_matches(clean_text, '[^\x20\x09-\x0D]'), false) AS kept, removed FROM t
"""

# A line is boilerplate in a host above 10 distinct texts and 5 % of the host's distinct texts.
SQL["op8_quality_rules"] = r"""
WITH b AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'k': i - 1}),
                     lambda z: regexp_matches(z.line, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: words[i:i + 7])) AS win
  FROM b WHERE len(words) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
ln AS (
  SELECT doc_id, host, text, unnest(lines) AS z FROM b),
norm AS (
  SELECT doc_id, host, text, z.k AS k,
         regexp_extract_all(translate(z.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS nw
  FROM ln),
total AS (SELECT host, count(DISTINCT text) AS documents FROM b GROUP BY host),
common AS (
  SELECT host, nw FROM (SELECT host, nw, count(DISTINCT text) AS found FROM norm GROUP BY host, nw) JOIN total USING (host)
  WHERE found > 10 AND found > 0.05 * documents),
gone AS (
  SELECT doc_id, sum(len(nw)) AS lost, string_agg(k, ',' ORDER BY k) AS places
  FROM norm SEMI JOIN common USING (host, nw) GROUP BY doc_id),
s AS (
  SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(list_transform(lines, lambda z: z.line))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost, 0) AS BIGINT) AS n_removed_words, coalesce(places, '') AS removed_lines
  FROM b LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (n_words - n_removed_words >= 0.3 * n_words) AS kept,
       n_removed_words, removed_lines
FROM s
"""

SQL["op11_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""

# Levels by joining neighbours until one node is left, first within each lang, then over the
# subroots; a proof is the sibling of every level, and folding it goes step by step.  CRC-32 is
# spelled out: eight shifts after every character.
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
SQL["op13_merkle_manifest"] = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *,
         xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                                lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END,
                         4294967295), 4294967295) AS crc
  FROM documents),
h AS (
  SELECT *, sha256(DOC || SOURCE || LANG || CHARS || TEXT) AS leaf, sha256(DOC || SOURCE || LANG || MORE || TEXT) AS other FROM d),
l AS (
  SELECT *, CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS given, coalesce('1' || lang, '0') AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM h),
t AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM t WHERE n > 1 GROUP BY tree, level, idx // 2, n),
s AS (
  SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
  FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM s
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 2, n),
steps AS (
  SELECT l.r, t.level AS k, (l.idx // CAST(pow(2, t.level) AS BIGINT)) % 2 AS side, b.digest
  FROM l JOIN t ON t.tree = l.tree AND t.n > 1 AND t.idx = l.idx // CAST(pow(2, t.level) AS BIGINT)
  LEFT JOIN t b ON b.tree = t.tree AND b.level = t.level AND b.idx = xor(t.idx, 1)
  UNION ALL
  SELECT l.r, s.height + u.level, (s.idx // CAST(pow(2, u.level) AS BIGINT)) % 2, b.digest
  FROM l JOIN s USING (tree) JOIN u ON u.n > 1 AND u.idx = s.idx // CAST(pow(2, u.level) AS BIGINT)
  LEFT JOIN u b ON b.level = u.level AND b.idx = xor(u.idx, 1)),
f AS (
  SELECT r, 0 AS k, given AS cur FROM l
  UNION ALL
  SELECT f.r, f.k + 1, sha256(CASE WHEN side = 1 THEN coalesce(digest, '') || cur ELSE cur || coalesce(digest, '') END)
  FROM f JOIN steps ON steps.r = f.r AND steps.k = f.k),
folded AS (SELECT r, arg_max(cur, k) AS cur FROM f GROUP BY r),
proof AS (SELECT r, string_agg(digest, '' ORDER BY k) AS all_siblings FROM steps GROUP BY r)
SELECT l.doc_id, leaf, subroot, u.digest AS root, sha256(coalesce(all_siblings, '')) AS proof_sha256,
       folded.cur AS folded_root, folded.cur = u.digest AS verified
FROM l JOIN s USING (tree) JOIN u ON u.n = 1 JOIN folded USING (r) LEFT JOIN proof USING (r)
"""
for _name, _column in {
    "DOC": "doc_id", "SOURCE": "source", "LANG": "lang", "CHARS": "n_chars", "MORE": "(n_chars + 1)", "TEXT": "text"
}.items():
    SQL["op13_merkle_manifest"] = SQL["op13_merkle_manifest"].replace(
        f"{_name} ||" if _name != "TEXT" else "TEXT)", _FIELD.format(_column) + (" ||" if _name != "TEXT" else ")")
    )
