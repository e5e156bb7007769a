"""Queries: acceptance windows, the risk map, streams and extension points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import z_value
from ..model import WindowOptions
from ..operators import collect, options, spatial, stats, windows
from ..session import shared_folder
from ..streaming import monitor
from .bindings import with_
from .register import registry, rounded

QUERIES, ORACLE, query = registry()
O = WindowOptions()  # noqa: E741
ZB, ZA = z_value(1 - O.beta), z_value(O.alpha)


def _obs(t):
    return t.observations.select("series_id", "d", "n")


@query("h2_neighbour_gaps", with_("observations", "SELECT series_id, round(d, 6) AS d, round(d - lag(d) OVER w, 6) AS gap_prev, round(lead(d) OVER w - d, 6) AS gap_next FROM observations WINDOW w AS (PARTITION BY series_id ORDER BY d)"))
def _(t):
    return rounded(windows.neighbour_gaps(_obs(t)).select("series_id", "d", "gap_prev", "gap_next"))


_IV = ("iv", "SELECT series_id, d AS a, d + 1 + (series_id % 7) * 2 AS b FROM observations")


def _merge_sql(src: str, slack: float) -> str:
    return f"SELECT series_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN mx IS NULL OR a > mx + {slack} THEN 1 ELSE 0 END AS nw FROM (SELECT *, max(b) OVER (PARTITION BY series_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM {src}))) GROUP BY series_id, isl"


def _iv(t):
    return t.observations.select("series_id", F.col("d").alias("a"), (F.col("d") + 1 + (F.col("series_id") % 7) * 2).alias("b"))


@query("h3_merge_intervals", with_("observations", f"SELECT series_id, round(a, 6) AS a, round(b, 6) AS b FROM ({_merge_sql('iv', 0)})", _IV))
def _(t):
    return rounded(windows.merge_intervals(_iv(t)))


@query("h4_close_gaps", with_("observations", f"SELECT series_id, round(a, 6) AS a, round(b, 6) AS b FROM ({_merge_sql('iv', 5)})", _IV))
def _(t):
    return rounded(windows.close_gaps(_iv(t), 5.0))


@query("h11_max_gap", with_("observations", "SELECT series_id, CAST(ceil(coalesce(max(g), 0)) AS BIGINT) AS max_gap FROM (SELECT series_id, lead(d) OVER (PARTITION BY series_id ORDER BY d) - d AS g FROM observations) GROUP BY series_id"))
def _(t):
    return windows.max_gap(_obs(t))


@query("i2_top_unions", with_("observations", "SELECT series_id, round(a, 6) AS a, round(gain, 6) AS gain FROM (SELECT *, (d * 7) % 11 AS gain, d AS a FROM observations) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY gain DESC, a) <= 3"))
def _(t):
    c = t.observations.select("series_id", F.col("d").alias("a"), F.col("d").alias("b"), ((F.col("d") * 7) % 11).alias("gain"))
    return rounded(windows.top_unions(c, 3).select("series_id", "a", "gain"))


@query("j1_union_windows", with_("observations", "SELECT series_id, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT series_id, a, b FROM iv UNION SELECT series_id, a, b FROM iv WHERE a > 20)", _IV))
def _(t):
    return rounded(windows.union_windows(_iv(t), _iv(t).filter("a > 20")))


@query("j2_fold_bounds", with_("observations", "SELECT series_id, CASE WHEN greatest(l1, l2) <= least(u1, u2) THEN greatest(l1, l2) ELSE least(l1, l2) END AS L, CASE WHEN greatest(l1, l2) <= least(u1, u2) THEN least(u1, u2) ELSE greatest(u1, u2) END AS U FROM (SELECT series_id, count(*) AS l1, count(*) + 5 AS u1, (series_id % 23) AS l2, (series_id % 23) + 3 AS u2 FROM observations GROUP BY series_id)"))
def _(t):
    n = t.observations.groupBy("series_id").agg(F.count("*").alias("c"))
    a = n.select("series_id", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.col("c").alias("L"), (F.col("c") + 5).alias("U"), F.lit(0).alias("ord"))
    b = n.select("series_id", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), (F.col("series_id") % 23).alias("L"), (F.col("series_id") % 23 + 3).alias("U"), F.lit(1).alias("ord"))
    return windows.fold_bounds(a.unionByName(b)).select("series_id", "L", "U")


_DAYS = ("days", "SELECT series_id, CAST(floor(d) AS BIGINT) AS day, sum(n) AS c FROM observations GROUP BY ALL")


def _mass_sql(win: str) -> str:
    return f"SELECT w.series_id, w.a, w.b, coalesce(sum(c * greatest(0, least(w.b, day + 1) - greatest(w.a, day))), 0) AS M FROM (SELECT DISTINCT series_id, a, b FROM {win}) w LEFT JOIN days o ON o.series_id = w.series_id AND day < w.b AND day + 1 > w.a GROUP BY w.series_id, w.a, w.b"


@query("k1_observed_mass", with_("observations", f"SELECT series_id, round(a, 6) AS a, round(b, 6) AS b, round(M, 6) AS M FROM ({_mass_sql('iv')})", _DAYS, _IV))
def _(t):
    return rounded(windows.observed_mass(_obs(t), _iv(t)))


_TOT = ("tot", "SELECT series_id, sum(n)::DOUBLE AS N FROM observations GROUP BY series_id")


def _band_sql(mass: str) -> str:
    p = f"({O.baseline_p} + least({O.h_max}, ({ZA}*sqrt(pi*(1-pi)/N+{ZA}*{ZA}/(4*N*N))/(1+{ZA}*{ZA}/N))/greatest(pi, {O.eps_share})))"
    return f"SELECT series_id, a, b, CAST(greatest(0, floor((1-{p})*M)) AS BIGINT) AS L, CAST(ceil((1+{p})*M) AS BIGINT) AS U FROM (SELECT m.*, N, M / N AS pi FROM ({mass}) m JOIN tot USING (series_id))"


@query("k2_band", with_("observations", f"SELECT series_id, round(a, 6) AS a, round(b, 6) AS b, L, U FROM ({_band_sql(_mass_sql('iv'))})", _DAYS, _IV, _TOT))
def _(t):
    return rounded(windows.band(windows.observed_mass(_obs(t), _iv(t)), windows.totals(_obs(t))).select("series_id", "a", "b", "L", "U"))


_CL = (
    ("half", f"SELECT series_id, d, greatest({ZB * O.sigma_days}, CASE WHEN gp IS NOT NULL AND gn IS NOT NULL THEN {O.neighbor_weight}*(gp+gn)/4 ELSE coalesce({O.neighbor_weight}*coalesce(gp, gn)/2, 0) END) AS h FROM (SELECT series_id, d, d - lag(d) OVER w AS gp, lead(d) OVER w - d AS gn FROM observations WINDOW w AS (PARTITION BY series_id ORDER BY d))"),
    ("raw", "SELECT series_id, d - h AS a, d + h AS b FROM half"),
    ("cl", _merge_sql("raw", 0)),
)


@query("k3_cluster_windows", with_("observations", "SELECT series_id, round(a, 5) AS a, round(b, 5) AS b FROM cl", *_CL))
def _(t):
    return rounded(windows.cluster_windows(_obs(t)), 5)


def _cubic(step: float) -> tuple:
    """The monotone cubic through cumulative counts on a grid: slopes of each knot, then the value between two knots."""
    end = lambda ha, hb, sa, sb: f"CASE WHEN {sb} IS NULL THEN {sa} WHEN sign(((2*{ha}+{hb})*{sa}-{ha}*{sb})/({ha}+{hb})) <> sign({sa}) THEN 0e0 WHEN sign({sa}) <> sign({sb}) AND abs(((2*{ha}+{hb})*{sa}-{ha}*{sb})/({ha}+{hb})) > 3*abs({sa}) THEN 3*{sa} ELSE ((2*{ha}+{hb})*{sa}-{ha}*{sb})/({ha}+{hb}) END"
    return (
        ("pts", "SELECT series_id, d, sum(sum(n)) OVER (PARTITION BY series_id ORDER BY d) AS y, count(*) OVER (PARTITION BY series_id) AS c FROM observations GROUP BY series_id, d"),
        ("sec", "SELECT *, lead(d) OVER w - d AS h, (lead(y) OVER w - y) / (lead(d) OVER w - d) AS s FROM pts WHERE c >= 2 WINDOW w AS (PARTITION BY series_id ORDER BY d)"),
        ("nei", "SELECT *, lag(h) OVER w AS h0, lag(s) OVER w AS s0, lag(h, 2) OVER w AS hm, lag(s, 2) OVER w AS sm, lead(h) OVER w AS h2, lead(s) OVER w AS s2 FROM sec WINDOW w AS (PARTITION BY series_id ORDER BY d)"),
        ("slo", f"SELECT series_id, d, y, h, CASE WHEN s0 IS NULL THEN {end('h', 'h2', 's', 's2')} WHEN s IS NULL THEN {end('h0', 'hm', 's0', 'sm')} WHEN s0 * s <= 0 THEN 0e0 ELSE 3 * (h0 + h) / ((2*h + h0) / s0 + (h + 2*h0) / s) END AS m FROM nei"),
        ("kno", "SELECT *, lead(y) OVER w AS y1, lead(m) OVER w AS m1, min(d) OVER (PARTITION BY series_id) AS first, max(d) OVER (PARTITION BY series_id) AS last FROM slo WINDOW w AS (PARTITION BY series_id ORDER BY d)"),
        ("pos", f"SELECT series_id, first, last, unnest(range(CAST(floor((last - first) / {step} + 1e-9) AS BIGINT) + 1)) AS i FROM (SELECT DISTINCT series_id, first, last FROM kno)"),
        ("grd", f"SELECT p.series_id, p.i, p.first + p.i * {step} AS x, k.d, k.y, k.h, k.m, k.y1, k.m1 FROM pos p ASOF JOIN kno k ON p.series_id = k.series_id AND p.first + p.i * {step} >= k.d - 1e-9"),
        ("cub", "SELECT series_id, i, x, CASE WHEN h IS NULL THEN y ELSE (2*t*t*t-3*t*t+1)*y + (t*t*t-2*t*t+t)*h*m + (3*t*t-2*t*t*t)*y1 + (t*t*t-t*t)*h*m1 END AS v FROM (SELECT *, greatest(0, (x - d) / h) AS t FROM grd)"),
    )


@query("k4_monotone_interpolant", with_("observations", "SELECT series_id, count(*) AS points, round(min(v), 4) AS lo, round(max(v), 4) AS hi FROM cub GROUP BY series_id", *_cubic(1.0)))
def _(t):
    g = windows.monotone_interpolant(_obs(t), 1.0)
    return rounded(g.groupBy("series_id").agg(F.count("*").alias("points"), F.min("v").alias("lo"), F.max("v").alias("hi")), 4)


@query("k5_segment_windows")
def _(t):
    return rounded(windows.segment_windows(_obs(t), windows.with_option(O, grid_step_days=1.0)), 4)


@query("k6_gap_windows", with_("observations", f"SELECT series_id, round(mid - h, 5) AS a, round(mid + h, 5) AS b FROM (SELECT series_id, (b+nx)/2 AS mid, least({O.gap_scale}*(nx-b), med/2) AS h FROM (SELECT *, lead(a) OVER (PARTITION BY series_id ORDER BY a) AS nx FROM cl) JOIN (SELECT series_id, quantile_cont(b-a, 0.5) AS med FROM cl GROUP BY series_id) USING (series_id) WHERE nx IS NOT NULL) WHERE h > 1e-3", *_CL))
def _(t):
    return rounded(windows.gap_windows(windows.cluster_windows(_obs(t)), O.gap_scale), 5)


def _union_parts(src: str) -> tuple:
    """Runs of up to five windows of ``src`` without a gap above a day, their bounds and what these gain: the table found."""
    return (
        ("brk", f"SELECT *, row_number() OVER w AS rk, CASE WHEN a - lag(b) OVER w > 1 THEN 1 ELSE 0 END AS gap FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY a, b)"),
        ("isl", "SELECT *, sum(gap) OVER (PARTITION BY series_id ORDER BY rk) AS run FROM brk"),
        ("runs", "SELECT x.series_id, x.a, max_by(y.b, y.rk) AS b, CAST(sum(y.L) AS BIGINT) AS sumL, CAST(sum(y.U) AS BIGINT) AS sumU FROM isl x, LATERAL (SELECT unnest(range(5)) AS more) JOIN isl z ON z.series_id = x.series_id AND z.run = x.run AND z.rk = x.rk + more JOIN isl y ON y.series_id = x.series_id AND y.rk BETWEEN x.rk AND x.rk + more GROUP BY x.series_id, x.a, x.rk, more"),
        ("own", _band_sql(_mass_sql("runs"))),
        ("bound", "SELECT r.series_id, r.a, r.b, sumL, sumU, greatest(o.L, sumL) AS L, least(o.U, sumU) AS U FROM runs r JOIN own o ON o.series_id = r.series_id AND o.a = r.a AND o.b = r.b"),
        ("found", f"SELECT series_id, a, b, L, U, (sumU - sumL) - (U - L) AS gain FROM bound WHERE (sumU - sumL) - (U - L) > 0 AND L <= U QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY (sumU - sumL) - (U - L) DESC, a, b) <= {O.max_unions_to_keep}"),
    )


@query("k7_union_candidates", with_("observations", "SELECT series_id, round(a, 4) AS a, round(b, 4) AS b, L, U, gain FROM found", *_CL, _DAYS, _TOT, ("cb", _band_sql(_mass_sql("cl"))), *_union_parts("cb")))
def _(t):
    c = windows.cluster_windows(_obs(t))
    b = windows.band(windows.observed_mass(_obs(t), c), windows.totals(_obs(t)))
    return rounded(windows.union_candidates(b, _obs(t)), 4)


@query("k8_acceptance_windows")
def _(t):
    return rounded(windows.acceptance_windows(_obs(t), windows.with_option(O, grid_step_days=1.0)), 4)


_SHARE = f"({O.baseline_p} + least({O.h_max}, ({ZA}*sqrt(pi*(1-pi)/N+{ZA}*{ZA}/(4*N*N))/(1+{ZA}*{ZA}/N))/greatest(pi, {O.eps_share})))"


def _fold(src: str) -> str:
    """Bounds of one interval in their order: the tightest of two that meet, else the loosest."""
    tight = "struct_pack(o := x.o, l := greatest(x.l, y.l), u := least(x.u, y.u))"
    loose = "struct_pack(o := x.o, l := least(x.l, y.l), u := greatest(x.u, y.u))"
    step = f"CASE WHEN greatest(x.l, y.l) <= least(x.u, y.u) THEN {tight} ELSE {loose} END"
    return f"SELECT series_id, a, b, f.l AS L, f.u AS U FROM (SELECT series_id, a, b, list_reduce(list(struct_pack(o := ord, l := L, u := U) ORDER BY ord, L, U), lambda x, y: {step}) AS f FROM {src} GROUP BY series_id, a, b)"


@query("k8_acceptance_clusters", with_(
    "observations", "SELECT series_id, round(a, 5) AS a, round(b, 5) AS b, L, U FROM (" + _fold("every") + ")",
    *_CL, _DAYS, _TOT,
    ("span", "SELECT series_id, min(d) AS first, max(d) AS last, sum(n)::DOUBLE AS M FROM observations GROUP BY series_id"),
    ("gaps", f"SELECT series_id, mid - h AS a, mid + h AS b FROM (SELECT series_id, (b+nx)/2 AS mid, least({O.gap_scale}*(nx-b), med/2) AS h FROM (SELECT *, lead(a) OVER (PARTITION BY series_id ORDER BY a) AS nx FROM cl) JOIN (SELECT series_id, quantile_cont(b-a, 0.5) AS med FROM cl GROUP BY series_id) USING (series_id) WHERE nx IS NOT NULL) WHERE h > 1e-3"),
    ("base", "SELECT series_id, a, b FROM cl UNION SELECT series_id, a, b FROM gaps"),
    ("bb", _band_sql(_mass_sql("base"))),
    ("held", "SELECT bb.series_id, greatest(a, least(first, 0e0)) AS a, least(b, last) AS b, L, U, 0 AS ord FROM bb JOIN span USING (series_id) WHERE least(b, last) > greatest(a, least(first, 0e0))"),
    ("cb", _fold("held")), *_union_parts("cb"),
    ("whole", _band_sql("SELECT series_id, least(first, 0e0) AS a, last AS b, M FROM span")),
    ("every", "SELECT series_id, a, b, L, U, 0 AS ord FROM cb UNION ALL SELECT series_id, a, b, L, U, 1 FROM found UNION ALL SELECT series_id, a, b, L, U, 2 FROM whole"),
))
def _(t):
    return rounded(windows.acceptance_windows(_obs(t), windows.with_option(O, strategy="cluster")).select("series_id", "a", "b", "L", "U"), 5)


@query("k9_segment_bands", with_(
    "observations", f"SELECT series_id, round(a, 4) AS a, round(b, 4) AS b, round(E, 4) AS E, CAST(greatest(0, floor((1-{_SHARE})*E)) AS BIGINT) AS L, CAST(ceil((1+{_SHARE})*E) AS BIGINT) AS U FROM (SELECT e.*, N, M / N AS pi FROM ex e JOIN mass m ON m.series_id = e.series_id AND m.a = e.a AND m.b = e.b JOIN tot ON tot.series_id = e.series_id)",
    *_CL, _DAYS, _TOT, *_cubic(1.0),
    ("win", "SELECT series_id, floor(a) AS a, b FROM cl"),
    ("ends", "SELECT w.series_id, a, b, greatest(0, least(CAST(round(a - x0) AS BIGINT), last)) AS ia, greatest(0, least(CAST(round(b - x0) AS BIGINT), last)) AS ib FROM win w JOIN (SELECT series_id, min(x) AS x0, max(i) AS last FROM cub GROUP BY series_id) g ON g.series_id = w.series_id"),
    ("ex", "SELECT n.series_id, n.a, n.b, y.v - x.v AS E FROM ends n JOIN cub x ON x.series_id = n.series_id AND x.i = n.ia JOIN cub y ON y.series_id = n.series_id AND y.i = n.ib WHERE y.v - x.v > 1e-9"),
    ("mass", _mass_sql("ex")),
))
def _(t):
    o = windows.with_option(O, grid_step_days=1.0)
    return rounded(windows.segment_bands(_obs(t), windows.cluster_windows(_obs(t)).withColumn("a", F.floor("a").cast("double")), o).select("series_id", "a", "b", "E", "L", "U"), 4)


def _seen(t):
    """Trajectories to test: the parents of a series in seven parts, in the days of its observations."""
    return t.parents.select(F.col("traj_id").alias("series_id"), (F.col("parent_id") % 7).alias("traj_id"), (F.col("t") * 3 + 109.6).alias("t"))


@query("k10_score_options")
def _(t):
    o = windows.with_option(O, grid_step_days=1.0)
    s = options.score_options(_obs(t), _seen(t), {0: o, 1: windows.with_option(o, strategy="cluster", baseline_p=0.6, h_max=0.8)})
    return rounded(options.best_options(s))


# Options by number: 27 of clusters, gaps and the total. In SQL a series' key is 32 times its number plus the option's.
_GRID = {9 * i + 3 * j + k: windows.with_option(O, strategy="cluster", include_union_windows=False, sigma_days=s, baseline_p=p, gap_scale=g, h_max=0.8) for i, s in enumerate((0.5, 1.8, 4.0)) for j, p in enumerate((0.3, 0.6, 0.95)) for k, g in enumerate((0.2, 0.4, 0.8))}
_OPT = ("opt", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {o.sigma_days}e0, {o.baseline_p}e0, {o.gap_scale}e0)" for i, o in _GRID.items()) + ") v(oid, sigma, p, gs)")
_ROW = f"(p + least(0.8e0, ({ZA}*sqrt(pi*(1-pi)/N+{ZA}*{ZA}/(4*N*N))/(1+{ZA}*{ZA}/N))/greatest(pi, {O.eps_share})))"


def _band_row(mass: str) -> str:
    return f"SELECT series_id, a, b, CAST(greatest(0, floor((1-{_ROW})*M)) AS BIGINT) AS L, CAST(ceil((1+{_ROW})*M) AS BIGINT) AS U FROM (SELECT m.*, N, M / N AS pi, p FROM ({mass}) m JOIN tot USING (series_id) JOIN opt ON oid = series_id % 32)"


_BY_OPTION = (
    _OPT,
    ("oo", "SELECT series_id * 32 + oid AS series_id, d, n FROM observations, opt"),
    ("days", "SELECT series_id, CAST(floor(d) AS BIGINT) AS day, sum(n) AS c FROM oo GROUP BY ALL"),
    ("tot", "SELECT series_id, sum(n)::DOUBLE AS N FROM oo GROUP BY series_id"),
    ("span", "SELECT series_id, min(d) AS first, max(d) AS last, sum(n)::DOUBLE AS M FROM oo GROUP BY series_id"),
    ("half", f"SELECT series_id, d, greatest({ZB} * sigma, CASE WHEN gp IS NOT NULL AND gn IS NOT NULL THEN {O.neighbor_weight}*(gp+gn)/4 ELSE coalesce({O.neighbor_weight}*coalesce(gp, gn)/2, 0) END) AS h FROM (SELECT series_id, d, d - lag(d) OVER w AS gp, lead(d) OVER w - d AS gn FROM oo WINDOW w AS (PARTITION BY series_id ORDER BY d)) JOIN opt ON oid = series_id % 32"),
    ("raw", "SELECT series_id, d - h AS a, d + h AS b FROM half"),
    ("cl", _merge_sql("raw", 0)),
    ("gaps", "SELECT series_id, mid - h AS a, mid + h AS b FROM (SELECT series_id, (b+nx)/2 AS mid, least(gs*(nx-b), med/2) AS h FROM (SELECT *, lead(a) OVER (PARTITION BY series_id ORDER BY a) AS nx FROM cl) JOIN (SELECT series_id, quantile_cont(b-a, 0.5) AS med FROM cl GROUP BY series_id) USING (series_id) JOIN opt ON oid = series_id % 32 WHERE nx IS NOT NULL) WHERE h > 1e-3"),
    ("base", "SELECT series_id, a, b FROM cl UNION SELECT series_id, a, b FROM gaps"),
    ("bb", _band_row(_mass_sql("base"))),
    ("held", "SELECT bb.series_id, greatest(a, least(first, 0e0)) AS a, least(b, last) AS b, L, U, 0 AS ord FROM bb JOIN span USING (series_id) WHERE least(b, last) > greatest(a, least(first, 0e0))"),
    ("cb", _fold("held")),
    ("whole", _band_row("SELECT series_id, least(first, 0e0) AS a, last AS b, M FROM span")),
    ("every", "SELECT series_id, a, b, L, U, 0 AS ord FROM cb UNION ALL SELECT series_id, a, b, L, U, 2 FROM whole"),
    ("win", "SELECT series_id // 32 AS series_id, series_id % 32 AS option_id, a, b, L, U FROM (" + _fold("every") + ")"),
)


@query("k10_windows_by_option", with_("observations", "SELECT series_id, option_id, round(a, 6) AS a, round(b, 6) AS b, L, U FROM win", *_BY_OPTION))
def _(t):
    return rounded(options.windows_by_option(_obs(t), options.option_table(t.spark, _GRID)))


@query("k10_option_grid", with_(
    "observations parents", "SELECT series_id, option_id, accepted, round(avg((y - cum / accepted) * (y - cum / accepted)) + CASE WHEN accepted < 80 THEN (80 - accepted) * (80 - accepted) ELSE 0 END, 4) AS objective FROM mean GROUP BY series_id, option_id, accepted",
    *_BY_OPTION,
    ("seen", "SELECT traj_id AS series_id, parent_id % 7 AS traj_id, t * 3 + 109.6e0 AS t FROM parents"),
    ("tested", "SELECT w.series_id, option_id, i.traj_id, bool_and((SELECT count(*) FROM seen e WHERE e.series_id = w.series_id AND e.traj_id = i.traj_id AND e.t BETWEEN w.a AND w.b) BETWEEN L AND U) AS ok FROM win w JOIN (SELECT DISTINCT series_id, traj_id FROM seen) i ON i.series_id = w.series_id GROUP BY ALL"),
    ("kept", "SELECT series_id, option_id, count(*) AS accepted FROM tested WHERE ok GROUP BY ALL"),
    ("cumul", "SELECT series_id, d, sum(sum(n)) OVER (PARTITION BY series_id ORDER BY d) AS y FROM observations GROUP BY series_id, d"),
    ("mean", "SELECT k.series_id, k.option_id, accepted, d, y, (SELECT count(*) FROM tested x JOIN seen e ON e.series_id = x.series_id AND e.traj_id = x.traj_id WHERE x.ok AND x.series_id = k.series_id AND x.option_id = k.option_id AND e.t <= c.d) AS cum FROM kept k JOIN cumul c ON c.series_id = k.series_id"),
))
def _(t):
    return rounded(options.score_options(_obs(t), _seen(t), options.option_table(t.spark, _GRID)), 4)


@query("k11_spec_sweep", with_("draws", "SELECT 'all' AS spec, count(*) AS n FROM draws UNION ALL SELECT 'low', count(*) FILTER (R0 < 6) FROM draws UNION ALL SELECT 'short', count(*) FILTER (alpha * theta < 12 AND k > 1) FROM draws"))
def _(t):
    return windows.spec_sweep(t.draws, {"all": [], "low": ["R0 < 6"], "short": ["alpha * theta < 12", "k > 1"]}).groupBy("spec").agg(F.count("*").alias("n"))


BOX, N = (16.0, 45.5, 23.0, 48.7), 16


def _points(t):
    return t.herds.select("herd_id", "herd_type", "herd_size", F.col("lon").alias("x"), F.col("lat").alias("y"))


def _params(t):
    return t.raw("nation").select(F.col("n_nationkey").alias("herd_type"), (1 + F.col("n_nationkey") % 4).cast("double").alias("weight"), (0.5 + F.col("n_nationkey") % 3 * 0.25).alias("power"))


_PW = ("pw", "SELECT herd_id, lon, lat, (1 + herd_type % 4) * pow(herd_size::DOUBLE, 0.5e0 + herd_type % 3 * 0.25e0) AS raw FROM herds WHERE herd_type < 12")
TYPES = list(range(12))


@query("l1_grid_cells", with_("herds", "SELECT ix, iy, round(15.5e0 + (ix + 0.5e0) * 8e0 / 16, 6) AS cx, round(45e0 + (iy + 0.5e0) * 4.2e0 / 16, 6) AS cy, count(*) AS herds FROM (SELECT CAST(least(floor((lon - 15.5e0) / 8e0 * 16), 15) AS BIGINT) AS ix, CAST(least(floor((lat - 45e0) / 4.2e0 * 16), 15) AS BIGINT) AS iy FROM herds WHERE lon BETWEEN 15.5e0 AND 23.5e0 AND lat BETWEEN 45e0 AND 49.2e0) GROUP BY ix, iy"))
def _(t):
    cell = lambda c, lo, hi: spatial.cell_of(F.col(c), lo - 0.5, hi + 0.5, N)
    held = _points(t).groupBy(cell("x", BOX[0], BOX[2]).alias("ix"), cell("y", BOX[1], BOX[3]).alias("iy")).agg(F.count("*").alias("herds"))
    return rounded(spatial.grid_cells(t.spark, BOX, N, 0.5).join(held, ["ix", "iy"]))


@query("l2_population_weights", with_("herds", "SELECT herd_id, round(raw / avg(raw) OVER (), 6) AS w FROM pw", _PW))
def _(t):
    return rounded(spatial.population_weights(_points(t), _params(t), TYPES).select("herd_id", "w"))


_CELLS = ("cells", "SELECT CAST(least(floor((lon-16)/7e0*16), 15) AS BIGINT) AS ix, CAST(least(floor((lat-45.5e0)/3.2e0*16), 15) AS BIGINT) AS iy, sum(raw) AS w FROM pw WHERE lon BETWEEN 16 AND 23 AND lat BETWEEN 45.5e0 AND 48.7e0 GROUP BY 1, 2")
_KER = ("ker", "SELECT dx, dy, k / sum(k) OVER () AS kw FROM (SELECT dx, dy, exp(-(dx*dx+dy*dy)/2e0) AS k FROM (SELECT unnest(range(-4, 5)) AS dx), (SELECT unnest(range(-4, 5)) AS dy))")
_FOLD = "CASE WHEN (({0}) % 32 + 32) % 32 < 16 THEN (({0}) % 32 + 32) % 32 ELSE 31 - (({0}) % 32 + 32) % 32 END"
_SMO = ("smo", f"SELECT {_FOLD.format('ix+dx')} AS ix, {_FOLD.format('iy+dy')} AS iy, sum(w*kw) AS w FROM cells, ker GROUP BY 1, 2")


def _cells(t):
    return spatial.weighted_cells(spatial.population_weights(_points(t), _params(t), TYPES, normalise=False), BOX, N)


@query("l3_kernel_smooth", with_("herds", "SELECT ix, iy, round(w, 6) AS w FROM smo", _PW, _CELLS, _KER, _SMO))
def _(t):
    return rounded(spatial.kernel_smooth(_cells(t), spatial.kernel_offsets(t.spark, "gaussian", sigma=1.0), N))


_POWER = ("ker", "SELECT dx, dy, k / sum(k) OVER () AS kw FROM (SELECT dx, dy, pow(sqrt(dx*dx+dy*dy) + 1, -2.5e0) AS k FROM (SELECT unnest(range(-6, 7)) AS dx), (SELECT unnest(range(-6, 7)) AS dy) WHERE dx*dx+dy*dy <= 36)")


@query("l3_power_law", with_("herds", "SELECT ix + dx AS ix, iy + dy AS iy, round(sum(w*kw), 6) AS w FROM cells, ker WHERE ix + dx BETWEEN 0 AND 15 AND iy + dy BETWEEN 0 AND 15 GROUP BY 1, 2", _PW, _CELLS, _POWER))
def _(t):
    return rounded(spatial.kernel_smooth(_cells(t), spatial.kernel_offsets(t.spark, "power", a=1.0, gamma=2.5, radius=6), N, "lose"))


@query("l4_risk_surface", with_("herds", "SELECT s.ix, s.iy, round(risk, 6) AS risk, round(1-exp(-2*risk), 6) AS p FROM (SELECT s.ix, s.iy, s.w / max(s.w) OVER () * coalesce(c.w / (SELECT max(w) FROM cells), 0) AS risk FROM smo s LEFT JOIN cells c USING (ix, iy)) s", _PW, _CELLS, _KER, _SMO))
def _(t):
    c = _cells(t)
    return rounded(spatial.risk_surface(spatial.kernel_smooth(c, spatial.kernel_offsets(t.spark, "gaussian", sigma=1.0), N), c, 2.0))


@query("l5_type_defaults", with_("herds", "SELECT herd_type, herd_id, herd_size FROM herds QUALIFY row_number() OVER (PARTITION BY herd_type ORDER BY herd_id) = 1"))
def _(t):
    return spatial.type_defaults(t.herds.select("herd_type", "herd_id", "herd_size"), "herd_id")


def _stream(t):
    """The events table as a file stream with the bound columns."""
    batch = t.raw("events")
    # A glob finds the table whether it is one file or a folder of parts.
    s = t.spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 86400e6
    return s.select(F.col("user_id").alias("traj_id"), at.alias("t"), F.col("ts").cast("timestamp").alias("ts"))


def _drain(t, df, schema: T.StructType, mode: str = "complete"):
    """Runs the stream over what there is and reads the last complete result, or, in update and append mode, the rows of all batches; a batch that
    runs again writes over its own rows."""
    path = f"{shared_folder(t.spark)}/outspan-stream-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return t.spark.read.schema(schema).parquet(f"{path}/out").select(*schema.fieldNames())


@query("m1_stream_hist1d", with_("ev", "SELECT CAST(least(floor(t/30e0*15), 14) AS BIGINT) AS bin, count(*) AS n FROM ev WHERE t BETWEEN 0 AND 30 GROUP BY 1"))
def _(t):
    s = monitor.stream_hist1d(_stream(t), "t", 15, 0.0, 30.0)
    return _drain(t, s, s.schema)


@query("m2_stream_time_matrix", with_("ev", "SELECT last_day, first_after, count(*) AS n FROM (SELECT traj_id, max(day) AS last_day, coalesce(min(day) FILTER (day > 20 AND day <= 28), 29) AS first_after FROM (SELECT traj_id, CAST(greatest(0, least(floor(t), 29)) AS BIGINT) AS day FROM ev) GROUP BY traj_id) GROUP BY ALL"))
def _(t):
    s = monitor.stream_day_state(_stream(t), 28, 20)
    return _drain(t, s, s.schema).groupBy("last_day", "first_after").agg(F.count("*").alias("n"))


@query("m3_stream_quiet_monitor", with_("ev", "SELECT traj_id, round((epoch_us(max(m)) - epoch_us(max(l))) / 86400e6, 6) AS quiet_days FROM (SELECT traj_id, max(ts) AS l FROM ev GROUP BY traj_id), (SELECT max(ts) AS m FROM ev) GROUP BY traj_id"))
def _(t):
    s = monitor.stream_quiet_monitor(_stream(t)).select("traj_id", "last_ts", "n")
    return rounded(monitor.quiet_times(_drain(t, s, s.schema, "update")))


_ALARMS = "SELECT traj_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_ts, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS alarm_ts FROM (SELECT traj_id, ts, lead(ts) OVER (PARTITION BY traj_id ORDER BY ts) AS next, max(ts) OVER () AS most FROM ev) WHERE (next IS NULL OR epoch_us(next) - epoch_us(ts) > 3 * 86400000000) AND epoch_us(ts) // 1000 + 2 * 86400000 < epoch_us(most) // 1000"


def _as_text(df):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.select("traj_id", at("last_ts"), at("alarm_ts"))


@query("m3_stream_quiet_alarms", with_("ev", _ALARMS))
def _(t):
    s = monitor.stream_quiet_alarms(_stream(t), "3 days")
    return _as_text(_drain(t, s, s.schema, "append"))


@query("m3_quiet_alarms", with_("ev", _ALARMS))
def _(t):
    return _as_text(monitor.quiet_alarms(t.ev, "3 days"))


@query("n6_collector_group", with_("entities ev", "SELECT e.traj_id, n, round(first_t, 6) AS first_t, signups FROM entities e LEFT JOIN (SELECT traj_id, count(*) AS n, min(t) AS first_t, count(*) FILTER (event_type = 'signup') AS signups FROM ev GROUP BY traj_id) x ON e.traj_id = x.traj_id"))
def _(t):
    group = [collect.Collector("n", F.count("*")), collect.Collector("first_t", F.min("t")), collect.Collector("signups", F.count_if(F.col("event_type") == "signup"))]
    return rounded(collect.collect_group(t.entities, t.ev, group))


def _span(state, x):
    if not len(x):
        return state
    return (x.min(), x.max()) if state is None else (min(state[0], x.min()), max(state[1], x.max()))


@query("n5_callable_summary", with_("draws", "SELECT alpha, round(max(R0) - min(R0), 6) AS spread FROM draws GROUP BY alpha"))
def _(t):
    spread = stats.Summary(lambda: None, _span, lambda a, b: a if b is None else b if a is None else (min(a[0], b[0]), max(a[1], b[1])), lambda s: None if s is None else s[1] - s[0])
    return rounded(stats.summarise(t.draws, ["alpha"], "R0", spread, "spread"))
