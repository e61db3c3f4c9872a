"""The registered queries in DuckDB's SQL, where SQL can express them."""

OP2 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM w),
f AS (SELECT remaining, weights FROM l WHERE remaining::DOUBLE * weight / weights < 3 * source_size ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN f.remaining IS NULL THEN 3.0 * source_size
         ELSE least((3 * source_size)::DOUBLE, f.remaining::DOUBLE * weight / f.weights) END AS target,
         (('0x' || substr(md5('mix:' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END || ':' || coalesce(source, '')), 1, 3))::INT + 0.5::DOUBLE) / 4096 AS u
  FROM l LEFT JOIN f ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * n + u) - floor(rate * (n - 1) + u)) * size)::BIGINT AS taken FROM r
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM g),
r AS (SELECT g, n, min(doc_id) AS node FROM s WHERE n > 0 GROUP BY g, n),
x AS (SELECT node, n, unnest(g) AS gram FROM r),
p AS (
  SELECT a.node AS a, b.node AS b FROM x AS a JOIN x AS b ON a.gram = b.gram AND a.node < b.node
  AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c AS (SELECT node AS a, node AS b FROM r UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
k AS (SELECT a, min(b) AS component_id FROM c GROUP BY a)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
FROM s LEFT JOIN r ON s.g = r.g AND s.n > 0 LEFT JOIN k ON r.node = k.a
"""

OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM w WHERE len(w) >= 13),
g AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS gram FROM p),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
h AS (SELECT doc_id, list(DISTINCT pos) AS ats FROM g JOIN f USING (gram) WHERE f.first < g.doc_id GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(ats, lambda a: range(a, a + 13)))) AS gone FROM h),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w WHERE len(w) > 0),
u AS (SELECT doc_id, unnest(gone) AS pos, true AS gone FROM c),
k AS (
  SELECT doc_id, count(*) FILTER (WHERE u.gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE u.gone IS NULL) AS kept
  FROM t LEFT JOIN u USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP5 = r"""
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e AS q JOIN e AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# Base32: five hexadecimal digits of the SHA-1 are four characters.
OP6 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, first FROM p JOIN g USING (payload))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

_CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"\p{L}+", r"\p{N}+", r"[\x20\x09-\x0D]+", r"[.,;:!?\x27\x22()-]+")
_RESTS = ["t"]
for _class in _CLASSES:
    _RESTS.append(f"regexp_replace({_RESTS[-1]}, '{_class}', '', 'g')")
_COUNTS = ", ".join([f"len({a}) - len({b})" for a, b in zip(_RESTS, _RESTS[1:])] + [f"len({_RESTS[-1]})"])


def _distance(p: str, q: str) -> str:
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END / 2"
    a, b = f"{p}[i]", f"{q}[i]"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(a, b)} + {part(b, a)})), 0))"


OP13 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS language, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS tokens
  FROM documents),
g AS (
  SELECT doc_id, pos, [w[pos], w[pos + 1], w[pos + 2]] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS pos FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT word) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS word FROM g SEMI JOIN r USING (doc_id, gram)) GROUP BY doc_id),
f AS (SELECT language, word, count(*) AS n FROM (SELECT language, unnest(tokens) AS word FROM d) GROUP BY language, word),
k AS (SELECT language, sum(n)::BIGINT AS known FROM f GROUP BY language HAVING sum(n) >= 1000),
p AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, word) AS place FROM f),
v AS (SELECT language, list(word ORDER BY place) AS common, list(n ORDER BY place) AS held FROM p WHERE place <= 32 GROUP BY language),
h AS (SELECT doc_id, language, [{_COUNTS}]::BIGINT[] AS classes FROM d),
s AS (
  SELECT language, list(n ORDER BY i) AS sums
  FROM (SELECT language, i, sum(classes[i])::BIGINT AS n FROM h, (SELECT unnest(range(1, 8)) AS i) GROUP BY language, i) GROUP BY language),
q AS (
  SELECT language, common, list_append(list_transform(held, lambda n: n / known), (known - list_sum(held)) / known) AS word_shares,
         list_transform(sums, lambda n: n / list_sum(sums)) AS class_shares
  FROM k JOIN v USING (language) JOIN s USING (language)),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(tokens) AS n, list_sum(classes) AS n_all, word_shares, class_shares,
         list_transform(common, lambda x: len(list_filter(tokens, lambda y: y = x))) AS found, classes
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN q ON d.language = q.language),
o AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         list_transform(list_append(found, n - list_sum(found)::BIGINT), lambda x: x / n) AS own_words, list_transform(classes, lambda x: x / n_all) AS own_classes
  FROM m),
j AS (
  SELECT *, CASE WHEN n >= 100 AND word_shares IS NOT NULL THEN round({_distance("own_words", "word_shares")}, 6) END AS word_distance,
         CASE WHEN n_all >= 200 AND word_shares IS NOT NULL THEN round({_distance("own_classes", "class_shares")}, 6) END AS class_distance
  FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, word_distance, class_distance,
       NOT base_failed AND coalesce(word_distance, 0) <= 0.45 AND coalesce(class_distance, 0) <= 0.33 AS kept
FROM j
"""


def _op11(rounds: int = 4) -> str:
    """Rounds of nearest entries and means, one after the other; squares through the inner product."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT id, part, min({{'d': xx + yy - 2 * list_dot_product(x, y), 'e': entry}}) AS best FROM p JOIN b{r} USING (part) GROUP BY id, part)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (
  SELECT part, best.e AS entry, place, floor(sum(value) / count(*)) AS mean
  FROM (SELECT part, best, unnest(x) AS value, unnest(range(len(x))) AS place FROM p JOIN a{r} USING (id, part)) GROUP BY ALL),
n{r} AS (SELECT part, entry, list(mean ORDER BY place) AS moved FROM m{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(moved, y) AS y, list_dot_product(coalesce(moved, y), coalesce(moved, y)) AS yy
  FROM b{r} LEFT JOIN n{r} USING (part, entry))"""
            )
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS MATERIALIZED (
  SELECT *, list_dot_product(x, x) AS xx
  FROM (SELECT id, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM e, (SELECT unnest(range(4)) AS part))),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x AS y, xx AS yy FROM p WHERE id <= 256),
{", ".join(steps)},
f AS (SELECT id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY id),
h AS (
  SELECT sha256(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(y) AS value, unnest(range(len(y))) AS place FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN f USING (id), h
"""


OP11 = _op11()


OP12 = r"""
WITH p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS MATERIALIZED (
  SELECT lang, size, w[i:i + size - 1] AS words, count(*) AS a
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)
  GROUP BY ALL),
n AS (SELECT lang, sum(a)::HUGEINT AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE size > 1 AND a >= 100),
i AS (SELECT lang, unnest([words[1:size - 1], words[2:size]]) AS words, a FROM c WHERE size > 2),
s AS (SELECT *, unnest(range(1, size)) AS k FROM c ANTI JOIN i USING (lang, words, a)),
t AS (
  SELECT s.lang, s.words, s.a, k, l.a AS l, r.a AS r, n, 1000::HUGEINT * s.a * n // (l.a::HUGEINT * r.a) AS score
  FROM s JOIN n USING (lang) JOIN g l ON l.lang = s.lang AND l.words = s.words[1:k] JOIN g r ON r.lang = s.lang AND r.words = s.words[k + 1:]),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
o AS (
  SELECT *, array_to_string(words, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
