"""The rows of the quality rules in DuckDB SQL: text functions over lists, and one chain of relations for all estimates.

It shares constants with ``quality_rules`` and nothing else; steps run to their maximum, which changes nothing once rows are the same."""

from __future__ import annotations

from .quality_rules import BASE_FAILED, CONSISTENCY, CUTOFF, FLOOR, MAX_STEPS, MEDIAN, PRIOR_ROWS, SUPPORT, VECTOR

N = range(1, 6)
LOWER = [(i, j) for i in N for j in range(1, i + 1)]
BIN = "CAST(floor(16e0 * ln(d2 + 1e-6)) AS BIGINT)"

STATS = [
    ("docs", "SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents"),
    ("split_", r"SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS ls FROM docs"),
    ("tri", "SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split_)"),
    ("twice", "SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM tri"),
    ("rep", "SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE n > 1) GROUP BY rid"),
    (
        "stats",
        r"""SELECT s.rid AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[!-/:-@\[-`{-~]')) AS n_punct, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(ls) AS n_lines FROM split_ s LEFT JOIN rep ON s.rid = rep.rid""",
    ),
    ("good", f"SELECT rid, lang, source, {', '.join(f'{x} AS x{i}' for i, x in enumerate(VECTOR, 1))} FROM stats WHERE NOT {BASE_FAILED}"),
    # both families of groups: whole languages, whose source is null, and sources
    ("v", "SELECT lang, NULL AS source, x1, x2, x3, x4, x5 FROM good UNION ALL SELECT lang, source, x1, x2, x3, x4, x5 FROM good"),
]


def _factor(relation: str, keys: str) -> str:
    """The Cholesky factor lij of scatter and floors, and the determinant."""
    cols = []
    for i, j in LOWER:
        less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        cols.append(f"sqrt(c{i}{i} + {FLOOR[i - 1] ** 2!r}{less}) AS l{i}{i}" if i == j else f"(c{i}{j}{less}) / l{j}{j} AS l{i}{j}")
    return f"SELECT {keys}, {', '.join(f'm{i}' for i in N)}, {', '.join(f'c{i}{j}' for i, j in LOWER)}, {', '.join(cols)}, power(l11 * l22 * l33 * l44 * l55, 2) AS det FROM {relation}"


def _solved(rows: str, estimate: str, keys: str, on: str) -> str:
    """Squared distances by forward substitution."""
    ys = []
    for i in N:
        less = "".join(f" - l{i}{k} * y{k}" for k in range(1, i))
        ys.append(f"(x{i} - m{i}{less}) / l{i}{i} AS y{i}")
    return f"SELECT {keys}, x1, x2, x3, x4, x5, {', '.join(ys)}, y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4 + y5 * y5 AS d2 FROM {rows} r JOIN {estimate} e ON {on}"


def op1_sql() -> str:
    ctes = list(STATS)
    group, same = "r.lang AS lang, r.source AS source", "r.lang = e.lang AND r.source IS NOT DISTINCT FROM e.source"
    xs = ", ".join(f"x{i}" for i in N)

    def median(name: str, rows: str) -> None:
        ctes.append((f"{name}_long", f"UNPIVOT (SELECT lang, source, {xs} FROM {rows}) ON {xs} INTO NAME c VALUE x"))
        ctes.append((f"{name}_cell", f"SELECT lang, source, c, floor(x * 256e0) AS b, count(*) AS n FROM {name}_long GROUP BY ALL"))
        ctes.append((f"{name}_sum", f"SELECT *, sum(n) OVER (PARTITION BY lang, source, c ORDER BY b) AS cn, sum(n) OVER (PARTITION BY lang, source, c) AS tot FROM {name}_cell"))
        ctes.append((name, f"SELECT lang, source, {', '.join(f'''max(CASE WHEN c = 'x{i}' THEN (b + 5e-1) / 256e0 END) AS x{i}''' for i in N)} FROM {name}_sum WHERE 2 * cn >= tot AND 2 * (cn - n) < tot GROUP BY lang, source"))

    median("med", "v")
    ctes.append(("dev", f"SELECT {group}, {', '.join(f'abs(r.x{i} - e.x{i}) AS x{i}' for i in N)} FROM v r JOIN med e ON {same}"))
    median("mad", "dev")
    robust = ", ".join(f"14826e-4 * 14826e-4 * e.x{i} * e.x{i} AS c{i}{j}" if i == j else f"0e0 AS c{i}{j}" for i, j in LOWER)
    plain = ", ".join(f"avg(x{i} * x{j}) - avg(x{i}) * avg(x{j}) AS c{i}{j}" for i, j in LOWER)
    ctes.append(("s0", f"SELECT {group}, 0 AS start, {', '.join(f'r.x{i} AS m{i}' for i in N)}, {robust} FROM med r JOIN mad e ON {same} UNION ALL SELECT lang, source, 1, {', '.join(f'avg(x{i})' for i in N)}, {plain} FROM v GROUP BY lang, source"))
    by = "PARTITION BY lang, source, start"
    for k in range(MAX_STEPS):
        ctes.append((f"p{k}", _factor(f"s{k}", "lang, source, start")))
        ctes.append((f"d{k}", _solved("v", f"p{k}", f"{group}, start", same)))
        sums = [f"x{i}" for i in N] + [f"x{i} * x{j}" for i, j in LOWER]
        names = [f"t{i}" for i in N] + [f"t{i}{j}" for i, j in LOWER]
        ctes.append((f"b{k}", f"SELECT lang, source, start, {BIN} AS b, count(*) AS n, {', '.join(f'sum({x}) AS {t}' for x, t in zip(sums, names, strict=True))} FROM d{k} GROUP BY lang, source, start, {BIN}"))
        ctes.append((f"a{k}", f"SELECT lang, source, start, n, sum(n) OVER ({by} ORDER BY b) AS cn, sum(n) OVER ({by}) AS tot, {', '.join(f'sum({t}) OVER ({by} ORDER BY b) AS {t}' for t in names)} FROM b{k}"))
        cov = ", ".join(f"t{i}{j} / cn - (t{i} / cn) * (t{j} / cn) AS c{i}{j}" for i, j in LOWER)
        ctes.append((f"s{k + 1}", f"SELECT lang, source, start, {', '.join(f't{i} / cn AS m{i}' for i in N)}, {cov} FROM a{k} WHERE cn >= {SUPPORT} * tot AND cn - n < {SUPPORT} * tot"))
    ctes.append(("ended", _factor(f"s{MAX_STEPS}", "lang, source, start")))
    wider = ", ".join(f"c{i}{j} * {CONSISTENCY} AS c{i}{j}" for i, j in LOWER)
    ctes.append(("best", f"SELECT lang, source, m1, m2, m3, m4, m5, {wider} FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY det, start) AS rn FROM ended) WHERE rn = 1"))
    ctes.append(("pb", _factor("best", "lang, source")))
    ctes.append(("db", _solved("v", "pb", group, same)))
    ctes.append(("bb", f"SELECT lang, source, {BIN} AS b, count(*) AS n FROM db GROUP BY lang, source, {BIN}"))
    ctes.append(("ab", "SELECT *, sum(n) OVER (PARTITION BY lang, source ORDER BY b) AS cn, sum(n) OVER (PARTITION BY lang, source) AS tot FROM bb"))
    ctes.append(("full_", f"SELECT r.*, tot, greatest(1e0, exp((b + 1) / 16e0) / {MEDIAN}e0) AS scale FROM best r JOIN ab e ON {same} WHERE 2 * cn >= tot AND 2 * (cn - n) < tot"))
    w = f"(g.tot / (g.tot + {PRIOR_ROWS}e0))"
    mean = ", ".join(f"{w} * g.m{i} + (1 - {w}) * h.m{i} AS m{i}" for i in N)
    cov = ", ".join(f"{w} * g.c{i}{j} + (1 - {w}) * h.c{i}{j} + {w} * (1 - {w}) * (g.m{i} - h.m{i}) * (g.m{j} - h.m{j}) AS c{i}{j}" for i, j in LOWER)
    ctes.append(("drawn", f"SELECT g.lang AS lang, g.source AS source, {mean}, {cov}, power(g.scale, {w}) * power(h.scale, 1 - {w}) AS scale FROM full_ g JOIN full_ h ON g.lang = h.lang WHERE g.source IS NOT NULL AND h.source IS NULL"))
    ctes.append(("known", _factor("drawn", "lang, source, scale")))
    ctes.append(("far", _solved("good", "known", "rid, scale", "r.lang = e.lang AND r.source = e.source")))
    failed = BASE_FAILED.replace("n_", "s.n_")
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes) + f"""
        SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, {failed} AS base_failed, NOT {failed} AND f.d2 / f.scale <= {CUTOFF} AS kept FROM stats s LEFT JOIN far f ON s.rid = f.rid"""
