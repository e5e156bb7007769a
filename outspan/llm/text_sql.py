"""SQL of the operators on words, vectors and shingles, written from their contracts: by other ways than the operators take."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_sql() -> str:
    """Checksums by a table of 256 remainders, replacements by patterns with a mark, indels by words with one letter cut out."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    return f"""WITH RECURSIVE
        tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: {step}) AS c FROM range(256) r(i))),
        runs AS (SELECT doc, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents) GROUP BY ALL),
        bytes AS (SELECT *, hex(encode(doc || ':' || run)) AS x FROM runs),
        sums AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::BIGINT) AS h FROM bytes, tab),
        typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cut AS (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
        marked AS (SELECT word, n, a || '?' || b AS p FROM cut),
        gone AS (SELECT DISTINCT word, n, a || b AS p FROM cut),
        near AS (
            SELECT x.word, y.word AS near, y.n AS near_n FROM marked x JOIN marked y ON x.p = y.p AND x.word <> y.word
            UNION ALL SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.p = w.word
            UNION ALL SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.p = w.word),
        best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
        known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
        chain AS (SELECT word, word AS root FROM known UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON c.root = k.word WHERE k.form IS NOT NULL)
        SELECT k.word, k.form, c.root, k.n, CAST(k.n_near AS BIGINT) AS n_near, k.form_n FROM known k JOIN chain c ON k.word = c.word JOIN known e ON c.root = e.word WHERE e.form IS NULL"""


def op12_sql(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> str:
    """Rounds written out, all distances compared in each."""
    floor = "(sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*)"
    parts = [
        f"kept AS (SELECT *, row_number() OVER () AS rid FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"v AS MATERIALIZED (SELECT rid, i, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dim + 1}) r(i))",
        f"start AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM start JOIN v USING (rid))",
    ]
    for r in range(rounds + 1):
        apart = f"SELECT v.rid, q.c, CAST(sum((v.x - q.x) * (v.x - q.x)) AS BIGINT) AS d FROM v JOIN c{r} q USING (i) GROUP BY v.rid, q.c"
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, c, d FROM ({apart}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN (SELECT a.c, v.i, CAST({floor} AS BIGINT) AS x FROM a{r} a JOIN v USING (rid) GROUP BY a.c, v.i) m ON o.c = m.c AND o.i = m.i)")
    parts.append(f"named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    body = f"SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} a JOIN kept USING (rid) JOIN named ON named.c = a.c"
    return "WITH " + ",\n".join(parts) + "\n" + body


def op13_sql() -> str:
    """Pairs that share a shingle, counted; classes by a walk over links."""
    return f"""WITH RECURSIVE
        words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i + 1:i + 3], ' '))) END AS s FROM words),
        grams AS (SELECT rid, doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        common AS (SELECT a.rid AS a, b.rid AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
        link AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (n + m - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        walk AS (SELECT rid AS a, rid AS b FROM sets UNION SELECT w.a, e.b FROM walk w JOIN edge e ON w.b = e.a),
        class AS (SELECT a AS rid, min(doc_id) AS component_id FROM walk JOIN sets ON sets.rid = walk.b GROUP BY a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM sets JOIN class USING (rid)"""
