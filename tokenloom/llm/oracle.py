"""DuckDB SQL for the operators that SQL can express; same column names as the queries."""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size,
              array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
             FROM d CROSS JOIN sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, p, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit
         FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
          WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""

_FIELD = "coalesce(concat(octet_length(encode(CAST({0} AS VARCHAR))), ':', {0}), '-')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CRC32 = """xor(4294967295, list_reduce(
  list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf('text')} AS leaf,
         CASE WHEN ({_CRC32}) % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")}
              ELSE {_leaf('text')} END AS claimed
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY lang) AS c,
             dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM d),
n AS (SELECT tree, 0 AS level, i, leaf AS h, c FROM l UNION ALL
      SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), max((c + 7) // 8) FROM n
      WHERE c > 1 GROUP BY tree, level, i // 8),
s AS (SELECT tree, h FROM n WHERE c = 1),
t AS (SELECT 0 AS level, tree - 1 AS i, h, (SELECT count(*) FROM s) AS c FROM s UNION ALL
      SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), max((c + 7) // 8) FROM t
      WHERE c > 1 GROUP BY level, i // 8),
r AS (SELECT tree, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM n WHERE c > 1 GROUP BY ALL
      UNION ALL SELECT 0, level, i // 8, list(h ORDER BY i) FROM t WHERE c > 1 GROUP BY ALL),
up AS (SELECT doc_id, leaf, tree AS own, tree, 0 AS level, i, claimed AS folded, '' AS proof FROM l UNION ALL
       SELECT doc_id, leaf, own, CASE WHEN len(hs) IS NULL THEN 0 ELSE up.tree END,
              CASE WHEN len(hs) IS NULL THEN 0 ELSE up.level + 1 END,
              CASE WHEN len(hs) IS NULL THEN own - 1 ELSE i // 8 END,
              CASE WHEN len(hs) IS NULL THEN folded
                   ELSE sha256(array_to_string(hs[1:i % 8], '') || folded || array_to_string(hs[i % 8 + 2:], '')) END,
              proof || coalesce(array_to_string(hs[1:i % 8], '') || array_to_string(hs[i % 8 + 2:], ''), '')
       FROM up LEFT JOIN r ON up.tree = r.tree AND up.level = r.level AND up.i // 8 = r.run
       WHERE r.tree IS NOT NULL OR up.tree > 0)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = t.h AS verified
FROM up JOIN s ON s.tree = own JOIN t ON t.c = 1
WHERE up.tree = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.tree = 0 AND r.level = up.level AND r.run = up.i // 8)
"""

OP13 = f"""
WITH p AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece
                 FROM documents)),
o AS (SELECT lang, 1 AS k, unnest(w) AS w FROM p UNION ALL
      SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') FROM (
        SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, w, k, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, w, k, f, string_split(w, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT lang, w, f, cut, array_to_string(ws[1:cut], ' ') AS lw, array_to_string(ws[cut + 1:], ' ') AS rw
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT x.*, l.f AS l, r.f AS r, (1000000 * x.f::HUGEINT * x.f::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.w = x.lw JOIN f r ON r.lang = x.lang AND r.w = x.rw),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
h AS (SELECT lang, w, max(f) AS longer FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS w, f FROM c WHERE k = 3 UNION ALL
      SELECT lang, array_to_string(ws[2:3], ' '), f FROM c WHERE k = 3) GROUP BY lang, w),
t AS (SELECT b.lang, b.w AS phrase, b.f AS a, l, r, n, CAST(score AS BIGINT) AS score
      FROM b JOIN n ON b.lang = n.lang LEFT JOIN h ON b.lang = h.lang AND b.w = h.w
      WHERE longer IS NULL OR 100 * longer < 50 * b.f)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM t)
WHERE rank <= 2000
"""
