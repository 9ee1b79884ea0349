"""DuckDB SQL for the training-data queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id,
  CAST(score AS BIGINT) AS score FROM s QUALIFY rank <= 5"""

# CRC-32 of ASCII text: its table by the rule, then one step a byte
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_THIRD = _CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))") + " % 3 = 0"


def _tree(name: str, leaves: str) -> str:
    """CTEs of a forest: nodes (g, lv, i, h), per node its siblings to the left and right."""
    return f"""{name}(g, lv, i, h, n) AS ({leaves} UNION ALL
  SELECT g, lv + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY g, lv, i // 8),
{name}_side AS (SELECT a.g, a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name} a JOIN {name} b ON a.g = b.g AND a.lv = b.lv AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.g, a.lv, a.i)"""


OP12 = f"""WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf('text')} AS leaf,
  CASE WHEN {_THIRD} THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf('text')} END AS given
  FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, given) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("t", "SELECT g, 0, i, leaf, n FROM p")},
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{_tree("u", "SELECT '', 0, i, subroot, n FROM s")},
f(g, doc_id, leaf, subroot, q, top, lv, i, h, proof, more) AS (
  SELECT g, doc_id, leaf, subroot, p.i, s.i, 0, p.i, given, '', true FROM p JOIN s USING (g) UNION ALL
  SELECT g, f.doc_id, leaf, subroot, q, top, CASE WHEN t_side.g IS NULL THEN -1 ELSE f.lv + 1 END,
    CASE WHEN t_side.g IS NULL THEN top ELSE f.i // 8 END,
    CASE WHEN t_side.g IS NULL THEN h ELSE sha256(coalesce(l, '') || h || coalesce(r, '')) END,
    proof || coalesce(l || r, ''), t_side.g IS NOT NULL
  FROM f LEFT JOIN t_side USING (g, lv, i) WHERE more),
k(g, q, lv, i, h, proof) AS (SELECT g, q, 0, top, h, proof FROM f WHERE NOT more UNION ALL
  SELECT k.g, q, k.lv + 1, k.i // 8, sha256(l || h || r), proof || l || r FROM k JOIN u_side ON k.lv = u_side.lv AND k.i = u_side.i),
e AS (SELECT g, q, max_by(h, lv) AS folded, max_by(proof, lv) AS proof FROM k GROUP BY g, q)
SELECT f.doc_id, f.leaf, f.subroot, u.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = u.h AS verified
FROM f JOIN e USING (g, q), u WHERE f.lv = 0 AND f.more AND u.n = 1"""

OP13 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""

OP11 = f"""WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
  unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
c AS (SELECT id, w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT w, n, {_CRC.format(bytes="flatten(list_transform(string_split(id || ':' || w, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [CAST(192 + unicode(s) // 64 AS BIGINT), 128 + unicode(s) % 64] END))")} AS h
  FROM c, crc_table),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0
    THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM x a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM x a JOIN v b ON a.rest = b.word),
g AS (SELECT v.word, v.n, count(other) AS n_near, min(CASE WHEN other IS NOT NULL THEN {{'m': -m, 'o': other}} END) AS best
  FROM v LEFT JOIN near USING (word) GROUP BY v.word, v.n),
f AS (SELECT word, n, n_near, CASE WHEN -best.m >= 5 * n THEN best.o END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n FROM g),
chain(word, reached, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON chain.reached = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, last.root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(reached, k) AS root FROM chain GROUP BY word) last USING (word)"""
