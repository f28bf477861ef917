"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def urls(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     hosted AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
     parsed AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
                       regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosted),
     rules(verdict, rhost, rpath) AS (VALUES {values}),
     named AS (SELECT *, row_number() OVER () AS n FROM parsed),
     best AS (SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
              FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN best USING (n)"""


TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


def license_scan(base, own) -> str:
    """Every start at which a template's key phrase stands, found by comparing slices of the word list."""
    templates = base + own
    text = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    at = ",\n".join(f"list_filter(range(0, len(w)), lambda i: w[i + 1:i + {t.size}] = {text(t.phrase)}) AS at{k}" for k, t in enumerate(templates))
    share = ", ".join(
        f"coalesce(list_max(list_transform(at{k}, lambda i: (" + " + ".join(
            f"coalesce(CAST(i + {j - t.key} >= 0 AND w[i + {j - t.key + 1}] = '{word}' AS INTEGER), 0)" for j, word in enumerate(t.words))
        + f") / {float(len(t.words))})), 0.0)" for k, t in enumerate(templates))
    label = lambda n: "coalesce(array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(
        f"CASE WHEN len(at{k}) > 0 THEN '{templates[k].label}' END" for k in range(n)) + "], lambda x: x IS NOT NULL))), ','), '')"
    every = " || ".join(f"at{k}" for k in range(len(base)))
    return f"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
               '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
     found AS (SELECT doc_id, w, {at} FROM words)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, CAST(list_min({every}) AS BIGINT) AS first_word,
       CAST(list_max({every}) AS BIGINT) AS last_word, {label(len(base))} AS base_labels, {label(len(templates))} AS labels,
       CAST(greatest({share}) AS DOUBLE) AS score FROM found"""


_LETTER = lambda hexes, shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, {hexes}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
     d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, payload_bytes, {" || ".join(_LETTER(5 * i + 1, s) for i in range(8) for s in (15, 10, 5, 0))} AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM d"""


def centroids(dim: int, k: int, rounds: int, scale: int, seed: str) -> str:
    """k-means with every round as tables of its own; means are floored in whole numbers."""
    steps = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS cluster, e
                         FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h, e LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
     d{r} AS (SELECT v.n, c.cluster, CAST(list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS d FROM v, c{r} c),
     a{r} AS MATERIALIZED (SELECT n, arg_min(cluster, d * {k} + cluster) AS cluster, min(d) AS d FROM d{r} GROUP BY n)""")
        if r < rounds:
            steps.append(f"""
     m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n) ORDER BY i) AS e
             FROM (SELECT a.cluster, t.i, CAST(sum(v.e[t.i]) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN v USING (n), range(1, {dim + 1}) t(i) GROUP BY a.cluster, t.i)
             GROUP BY cluster),
     c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return ",".join(steps) + f"""
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (n) JOIN c{rounds} c ON c.cluster = a.cluster"""


def resampled(percent: int, least_words: int, buckets: int, seed: str) -> str:
    """Features of whole texts, without lines; the checksum (reflected, polynomial 0xEDB88320) is folded byte by byte over a table made by its rule."""
    words = lambda table, key: f"""SELECT {key} AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
               '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table}"""
    runs = "list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS n, * FROM ({words('documents', 'doc_id')})),
     wanted AS ({words('benchmark', 'item_id')}),
     crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
                   lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
     of_docs AS (SELECT n, f, count(*) AS times FROM (SELECT n, unnest({runs}) AS f FROM docs) GROUP BY n, f),
     of_wanted AS (SELECT f, count(*) AS times FROM (SELECT unnest({runs}) AS f FROM wanted) GROUP BY f),
     bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM of_docs UNION SELECT f FROM of_wanted)),
     hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS b FROM bytes, crc_table),
     s AS (SELECT b, sum(times) AS s FROM of_docs JOIN hashed USING (f) GROUP BY b),
     t AS (SELECT b, sum(times) AS t FROM of_wanted JOIN hashed USING (f) GROUP BY b),
     totals AS (SELECT CAST((SELECT coalesce(sum(s), 0) FROM s) AS DOUBLE) AS s_all, CAST((SELECT coalesce(sum(t), 0) FROM t) AS DOUBLE) AS t_all),
     gains AS MATERIALIZED (SELECT s.b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + {buckets}) / ((CAST(s AS DOUBLE) + 1) * (t_all + {buckets})))) AS BIGINT) AS gain
              FROM s LEFT JOIN t USING (b), totals),
     weights AS (SELECT n, CAST(sum(times) AS BIGINT) AS n_features, CAST(sum(times * gain) AS BIGINT) AS g FROM of_docs JOIN hashed USING (f) JOIN gains USING (b) GROUP BY n),
     weighed AS (SELECT d.n, d.id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features,
                        coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0) AS weight,
                        CAST('0x' || substr(sha256('{seed}:' || CAST(d.id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM docs d LEFT JOIN weights USING (n)),
     scored AS (SELECT n, doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
     ranked AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE words >= {least_words})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN rank <= {percent} * able // 100 THEN rank END AS BIGINT) AS rank FROM scored LEFT JOIN ranked USING (n)"""
