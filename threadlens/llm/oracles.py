"""DuckDB SQL for the queries that SQL can express, written from the contracts."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

OP1 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS w FROM documents),
  items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS w FROM benchmark),
  iw AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS g, least(len(w), 13) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
  dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
  hits AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN iw ON dw.g = iw.g),
  places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
  found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hits GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
  FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)"""

# The method's rules beside the contract's two, written out here once more.
_FAILS = ["n_words < 50", "100 * n_repeat_words > 50 * n_words", "4 * n_symbols > n_words", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "2 * n_upper > word_chars"]
_NAMES = ["few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "upper_case"]
_POLICIES = {"base": 3, "2024-1": 15, "2024-2": 63}
_BITS = " + ".join(f"(CASE WHEN {condition} THEN {1 << b} ELSE 0 END)" for b, condition in enumerate(_FAILS))
_MEASURED = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
  grams AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
  covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
  lined AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS lines FROM d),
  m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM lined LEFT JOIN covered USING (doc_id)),
  b AS (SELECT *, CAST({_BITS} AS BIGINT) AS bits FROM m)"""
OP2 = _MEASURED + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, bits = 0 AS kept, bits AS fail_bits, '2024-2' AS policy FROM b"
_COSTS = " UNION ALL ".join(
    f"SELECT '{policy}' AS policy, '{name}' AS rule, count(*) FILTER (WHERE bits & {1 << b} <> 0) AS n_failed, count(*) FILTER (WHERE bits & {mask} = {1 << b}) AS n_failed_alone, count(*) FILTER (WHERE bits & {mask & ~(1 << b)} = 0) AS n_kept_without FROM b"
    for policy, mask in _POLICIES.items() for b, name in enumerate(_NAMES) if mask >> b & 1
)
OP2_ABLATION = _MEASURED + " " + _COSTS


# kind, pattern, judged group and its least length: the contract's three, then the method's own
_SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
]


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, coalesce(list_sum(list_transform(list_slice(gaps, 1, k), lambda x: length(x))), 0) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda x: length(x))), 0) AS a, length(m[k]) AS n, length(j[k]) AS judged
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS j FROM d)) WHERE length(j[k]) >= {least}"""


OP6 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({" UNION ALL ".join(_spans(k, *r) for k, r in enumerate(_SECRETS))}),
  t AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (doc_id)"""

OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
  g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
  late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
  gone AS (SELECT doc_id, p FROM (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late))),
  each AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.p GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_SPACED}') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS r FROM reach GROUP BY a) USING (doc_id)"""

# k-means by the full scan: one step for each of the five moves, written out from the contract.
_KEPT = """x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
  c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM x ORDER BY sha256('2:' || vec_id) LIMIT 40)"""
_NEAREST = "SELECT vec_id, any_value(v) AS v, min(CAST(d AS BIGINT)) AS distance, CAST(arg_min(cluster, [d, cluster]) AS INTEGER) AS cluster FROM (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM x, c{0}) GROUP BY vec_id"
_MOVED = """s{0} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{0}, range(1, 65) t(i) GROUP BY ALL),
  m{0} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{0} GROUP BY cluster), c{1} AS (SELECT cluster, coalesce(m.c, old.c) AS c FROM c{0} old LEFT JOIN m{0} m USING (cluster))"""
_ROUNDS = ", ".join(f"a{r} AS MATERIALIZED ({_NEAREST.format(r)}), {_MOVED.format(r, r + 1)}" for r in range(5))
OP12 = f"""WITH {_KEPT}, {_ROUNDS}, a5 AS MATERIALIZED ({_NEAREST.format(5)})
  SELECT vec_id, a5.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a5.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a5 JOIN c5 ON c5.cluster = a5.cluster"""

# CRC-32 by a table made from the polynomial, over each different word once.
OP13 = f"""WITH crc AS MATERIALIZED (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
  d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS w FROM documents), dw AS (SELECT doc_id, unnest(w) AS word FROM d),
  bw AS (SELECT unnest(regexp_extract_all({_FOLDED}, '{_ALNUM}')) AS word FROM benchmark),
  hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
  bucket AS MATERIALIZED (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: (strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 10000 AS b FROM hexed, crc),
  ds AS (SELECT b, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY b), bt AS (SELECT b, count(*) AS t FROM bw JOIN bucket USING (word) GROUP BY b),
  total AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
  gain AS (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g FROM ds FULL JOIN bt USING (b), total),
  w AS (SELECT doc_id, sum(g) AS g, count(*) AS n FROM dw JOIN bucket USING (word) JOIN gain USING (b) GROUP BY doc_id),
  scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight, CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
  final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
  ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM final WHERE n_features >= 20)
  SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) * 10 // 100 FROM final WHERE n_features >= 20) THEN r END AS rank FROM final LEFT JOIN ranked USING (doc_id)"""
