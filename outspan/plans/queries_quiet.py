"""Queries: probabilities that it is over."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import wilson_interval, z_value
from ..operators import collect, criteria, curves, quiet
from ..operators.ranks import percentiles
from ..sources import ingest
from .bindings import EDGE_STAR, T_STAR, erlang, grid_sql, thinned_sql, with_
from .register import registry, rounded

QUERIES, ORACLE, query = registry()
SIGNUP = "event_type = 'signup'"
_SG = ("sg", "SELECT * FROM ev WHERE event_type = 'signup'")
_FP = ("fp", f"SELECT e.traj_id, min(v.t) FILTER (v.t > {T_STAR}) - {T_STAR} AS first_post, max(v.t) AS last_t FROM entities e LEFT JOIN sg v ON e.traj_id = v.traj_id GROUP BY e.traj_id")
_G = ("g", grid_sql(0, 10, 1))
Z = z_value(0.1)


def _signups(t):
    return t.ev.filter(SIGNUP).select("traj_id", "t")


@query("p1_empirical_uncond", with_("entities ev", f"SELECT T, round(p, 6) AS p, round(sqrt(p*(1-p)/n), 6) AS se FROM (SELECT T, avg(CASE WHEN last_t IS NULL OR last_t <= {T_STAR}+T THEN 1e0 ELSE 0e0 END) AS p, count(*) AS n FROM fp, g GROUP BY T)", _SG, _FP, _G))
def _(t):
    return rounded(quiet.empirical_uncond(t.entities, _signups(t), t.grid(0, 10, 1), T_STAR))


_WP = f"(p + {Z}*{Z}/(2*n))/(1+{Z}*{Z}/n)"
_WH = f"{Z}*sqrt(p*(1-p)/n+{Z}*{Z}/(4*n*n))/(1+{Z}*{Z}/n)"


@query("p2_empirical_cond", with_("entities ev", f"SELECT T, n, round(p, 6) AS p, round(greatest(0, {_WP} - {_WH}), 6) AS lo, round(least(1, {_WP} + {_WH}), 6) AS hi FROM (SELECT T, count(*) FILTER (first_post IS NULL OR first_post > T) AS n, count(*) FILTER (first_post IS NULL) / nullif(count(*) FILTER (first_post IS NULL OR first_post > T), 0)::DOUBLE AS p FROM fp, g GROUP BY T)", _SG, _FP, _G))
def _(t):
    out = quiet.empirical_cond(t.entities, _signups(t), t.grid(0, 10, 1), T_STAR)
    lo, hi = wilson_interval("p", "n", Z)
    return rounded(out.select("T", "n", "p", lo.alias("lo"), hi.alias("hi")))


@query("p3_cond_denominator", with_("entities ev", "SELECT T, count(*) FILTER (first_post IS NULL OR first_post > T) AS n FROM fp, g GROUP BY T", _SG, _FP, _G))
def _(t):
    return quiet.empirical_cond(t.entities, _signups(t), t.grid(0, 10, 1), T_STAR).select("T", "n")


_SNAPS = ("snaps", "SELECT CAST(i AS BIGINT) AS snap_id, 10e0 + 5 * i AS ts FROM range(4) r(i)")


def _progressive_sql(snaps: tuple[str, str]) -> str:
    return with_("entities ev", "SELECT snap_id, T, count(*) FILTER (first_post IS NULL OR first_post > T) AS n, round(count(*) FILTER (first_post IS NULL) / nullif(count(*) FILTER (first_post IS NULL OR first_post > T), 0)::DOUBLE, 6) AS p FROM (SELECT s.snap_id, e.traj_id, min(v.t) FILTER (v.t > s.ts) - s.ts AS first_post FROM snaps s CROSS JOIN entities e LEFT JOIN sg v ON e.traj_id = v.traj_id GROUP BY s.snap_id, s.ts, e.traj_id), g GROUP BY snap_id, T", _SG, snaps, _G)


def _progressive(t, snaps):
    """Conditional curves of each snapshot (snap_id, ts)."""
    v = _signups(t).crossJoin(F.broadcast(snaps)).filter(F.col("t") > F.col("ts")).groupBy("snap_id", "traj_id").agg(F.min(F.col("t") - F.col("ts")).alias("first_post"))
    first = t.entities.crossJoin(F.broadcast(snaps.select("snap_id"))).join(v, ["snap_id", "traj_id"], "left")
    return rounded(quiet.cond_from_first(first, t.grid(0, 10, 1), ("snap_id",)).select("snap_id", "T", "n", "p"))


@query("p4_progressive_cond", _progressive_sql(_SNAPS))
def _(t):
    return _progressive(t, t.spark.sql("SELECT id AS snap_id, 10e0 + 5 * id AS ts FROM range(4)"))


# Snapshots at uneven distances, so that a curve ends between two points of its grid.
_UNEVEN = "10e0 + 4.5e0 * {0} + 0.25e0 * {0} * {0}"
_ONLINE = (
    f"SELECT s.snap_id, round(s.ts - 10e0 + c.T, 6) AS x, c.p, round(CASE WHEN gap = floor(gap) THEN lo.p ELSE lo.p + (hi.p - lo.p) * (gap - floor(gap)) END, 6) AS p_end "
    "FROM (SELECT *, coalesce(lead(ts) OVER (ORDER BY ts) - ts, 6.5e0) AS gap FROM (SELECT CAST(i AS BIGINT) AS snap_id, " + _UNEVEN.format("i") + " AS ts FROM range(4) r(i))) s "
    "JOIN curve c ON c.snap_id = s.snap_id AND c.T <= gap LEFT JOIN curve lo ON lo.snap_id = s.snap_id AND lo.T = floor(gap) LEFT JOIN curve hi ON hi.snap_id = s.snap_id AND hi.T = floor(gap) + 1"
)


@query("f20_online_progressive", f"WITH curve AS ({_progressive_sql(('snaps', 'SELECT CAST(i AS BIGINT) AS snap_id, ' + _UNEVEN.format('i') + ' AS ts FROM range(4) r(i)'))}) {_ONLINE}")
def _(t):
    snaps = t.spark.sql(f"SELECT id AS snap_id, {_UNEVEN.format('id')} AS ts FROM range(4)")
    curve = _progressive(t, snaps).withColumn("series_id", F.lit(1))
    gaps = curves.next_gap(snaps.select(F.lit(1).alias("series_id"), "snap_id", F.col("ts").alias("t_star")), 6.5)
    return rounded(curves.online_curve(curve, gaps).select("snap_id", "x", "p", "p_end"))


_SEED = ("fp", f"SELECT c.traj_id, min(child_t) - {EDGE_STAR} AS first_post FROM customers c LEFT JOIN (SELECT * FROM edges WHERE parent_t <= {EDGE_STAR} AND child_t > {EDGE_STAR}) e ON c.traj_id = e.traj_id GROUP BY c.traj_id")


@query("p5_seed_cond", with_("customers edges", "SELECT T, count(*) FILTER (first_post IS NULL) AS over, count(*) FILTER (first_post IS NULL OR first_post > T) AS n, round(count(*) FILTER (first_post IS NULL) / nullif(count(*) FILTER (first_post IS NULL OR first_post > T), 0)::DOUBLE, 6) AS p FROM fp, g GROUP BY T", _SEED, _G))
def _(t):
    return rounded(quiet.seed_cond(t.customers, t.edges, t.grid(0, 10, 1), EDGE_STAR).select("T", "over", "n", "p"))


def _pdf(x: str) -> str:
    """Gamma density for shapes 1 to 4."""
    return f"(pow({x}, alpha - 1) * exp(-({x}) / theta) / (pow(theta, alpha) * CASE WHEN alpha < 3 THEN 1 WHEN alpha < 4 THEN 2 ELSE 6 END))"


def _survival(n: int, h: float) -> tuple[str, str]:
    """Extinction by age for each distinct key: the list grows by one element a step, from a product of densities and the list reversed."""
    step = "pow(b / greatest(b + 1 - list_inner_product(f[1:len(acc)], list_reverse(acc)), 1e-12), k)"
    return ("tab", f"SELECT R, k, alpha, theta, list_reduce(list_prepend([pow(b / (b + 1), k)], list_transform(range({n}), lambda i: [0e0])), lambda acc, x: list_append(acc, {step})) AS H FROM (SELECT *, k / R AS b, list_transform(range(1, {n + 1}), lambda j: {h} * {_pdf(f'({h} * j)')}) AS f FROM (SELECT DISTINCT round(r * R0, 6) AS R, round(k, 6) AS k, alpha, theta FROM draws))")


@query("p6_survival_table", with_("draws", "SELECT R, k, CAST(alpha AS DOUBLE) AS alpha, theta, round(H[1], 6) AS h0, round(H[len(H)], 6) AS h30 FROM tab", _survival(150, 0.2)))
def _(t):
    keys = t.draws.select(F.round(F.col("r") * F.col("R0"), 6).alias("R"), F.round("k", 6).alias("k"), F.col("alpha").cast("double").alias("alpha"), "theta").distinct()
    s = quiet.survival_table(keys, 30.0, 0.2)
    return rounded(s.select("R", "k", "alpha", "theta", F.get("H", F.lit(0)).alias("h0"), F.element_at("H", -1).alias("h30")))


def _seed_sql(step: int) -> str:
    """Products over crossing seeds; the table is read between its two nearest ages."""
    return with_(
        "draws edges", "SELECT T, round(avg(g), 6) AS p FROM per GROUP BY T", _survival(150, 0.2), ("gr", grid_sql(0, 20, step)),
        ("seed", f"SELECT d.traj_id, child_t AS s, H FROM edges e JOIN draws d ON e.traj_id = d.traj_id JOIN tab ON tab.R = round(d.r * d.R0, 6) AND tab.k = round(d.k, 6) AND tab.alpha = d.alpha AND tab.theta = d.theta WHERE parent_t <= {EDGE_STAR} AND child_t > {EDGE_STAR}"),
        ("pos", f"SELECT traj_id, T, s, H, greatest({EDGE_STAR} + T - s, 0e0) / 0.2e0 AS y FROM seed, gr"),
        ("val", "SELECT traj_id, T, s, H[CAST(floor(y) AS INTEGER) + 1] * (1 - (y - floor(y))) + H[CAST(floor(y) AS INTEGER) + 2] * (y - floor(y)) AS v FROM pos"),
        ("prod", f"SELECT traj_id, T, CASE WHEN {EDGE_STAR} + T < max(s) THEN 0e0 ELSE exp(sum(ln(greatest(v, 1e-300)))) END AS g FROM val GROUP BY traj_id, T"),
        ("per", "SELECT T, coalesce(g, 1e0) AS g FROM (SELECT traj_id, T FROM draws, gr) LEFT JOIN prod USING (traj_id, T)"),
    )


@query("p7_seed_uncond", _seed_sql(1))
def _(t):
    return rounded(quiet.seed_uncond(t.draws, t.edges, t.grid(0, 20, 1), EDGE_STAR))


def _parents(t):
    return quiet.pre_children(criteria.mark_roots(t.parents, "parent_id"), t.edges, EDGE_STAR)


_PAR = (
    ("roots", "SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t, parent_id) = 1 AS is_root FROM parents"),
    ("pre", f"SELECT parent_id, count(*) AS n FROM edges WHERE parent_t <= {EDGE_STAR} AND child_t <= {EDGE_STAR} AND child_t > parent_t GROUP BY parent_id"),
    ("pp", f"SELECT p.traj_id, CASE WHEN is_root THEN R0 ELSE r * R0 END AS Reff, {EDGE_STAR} - t AS age, k, alpha, theta, R0, coalesce(n, 0) AS n_pre FROM roots p JOIN draws d ON p.traj_id = d.traj_id LEFT JOIN pre ON pre.parent_id = p.parent_id WHERE t <= {EDGE_STAR}"),
    ("g", grid_sql(0, 20, 4)),
)


def _rb_sql(post: bool) -> str:
    kk, b = ("(k + n_pre)", "(k/Reff + F0)") if post else ("k", "(k/Reff)")
    return with_(
        "parents edges draws",
        "SELECT T, round(avg(gi)/avg(gq), 6) AS p, count(*) AS n FROM q JOIN i USING (traj_id) GROUP BY T",
        *_PAR,
        ("pf", f"SELECT *, {erlang('age')} AS F0 FROM pp"),
        ("i", f"SELECT traj_id, exp(sum({kk} * ln({b}/({b} + 1 - F0)))) AS gi FROM pf GROUP BY traj_id"),
        ("q", f"SELECT traj_id, T, exp(sum({kk} * ln({b}/({b} + mu)))) AS gq FROM (SELECT *, {erlang('(age + T)')} - F0 AS mu FROM pf, g) GROUP BY traj_id, T"),
    )


@query("p8_rb_cond_prior", _rb_sql(False))
def _(t):
    return rounded(quiet.rb_cond_curve(quiet.rao_blackwell(_parents(t), t.draws, t.grid(0, 20, 4), EDGE_STAR, False)))


@query("p9_rb_cond_post", _rb_sql(True))
def _(t):
    return rounded(quiet.rb_cond_curve(quiet.rao_blackwell(_parents(t), t.draws, t.grid(0, 20, 4), EDGE_STAR, True)))


@query("p10_rb_cond_draws", _rb_sql(True).replace("SELECT T, round(avg(gi)/avg(gq), 6) AS p, count(*) AS n FROM q JOIN i USING (traj_id) GROUP BY T", "SELECT traj_id, T, round(gi/gq, 6) AS p FROM q JOIN i USING (traj_id)"))
def _(t):
    rb = quiet.rao_blackwell(_parents(t), t.draws, t.grid(0, 20, 4), EDGE_STAR, True)
    return rounded(rb.select("traj_id", "T", (F.col("g_inf") / F.col("g_quiet")).alias("p")))


def _uncond_sql() -> str:
    """Chances that all descendants end by T, from the table and each parent's density after the cutoff; T lies on the table's grid."""
    after = f"list_inner_product(list_transform(range(1, i + 1), lambda j: 0.2 * {_pdf('(age + 0.2 * j)')}), list_reverse(list_transform(H[1:i], lambda x: 1 - x)))"
    return with_(
        "parents edges draws", "SELECT T, round(avg(g), 6) AS p, count(*) AS n FROM per GROUP BY T", *_PAR, _survival(150, 0.2),
        ("own", "SELECT pp.*, H FROM pp JOIN draws d ON pp.traj_id = d.traj_id JOIN tab ON tab.R = round(d.r * d.R0, 6) AND tab.k = round(d.k, 6) AND tab.alpha = d.alpha AND tab.theta = d.theta"),
        ("psi", f"SELECT traj_id, T, k + n_pre AS kk, k / Reff + {erlang('age')} AS b, 1 - {erlang('(age + T)')} + CASE WHEN i = 0 THEN 0e0 ELSE {after} END AS y FROM (SELECT *, CAST(round(T * 5) AS BIGINT) AS i FROM own, g)"),
        ("per", "SELECT traj_id, T, exp(sum(kk * ln(b / (b + y)))) AS g FROM psi GROUP BY traj_id, T"),
    )


@query("p11_rb_uncond", _uncond_sql())
def _(t):
    g = quiet.rb_uncond(_parents(t), t.draws, [float(x) for x in range(0, 21, 4)], EDGE_STAR)
    return rounded(g.groupBy("T").agg(F.avg("g").alias("p"), F.count("*").alias("n")))


@query("p13_subset_curves", _rb_sql(True).replace("is_root FROM parents)", "is_root FROM parents WHERE traj_id IN (SELECT c_custkey FROM customer ORDER BY md5('5:' || c_custkey), c_custkey LIMIT 200))"))
def _(t):
    ids = ingest.choose(t.customers, 200, 5)
    keep = lambda df: df.join(F.broadcast(ids), "traj_id", "left_semi")
    return rounded(quiet.rb_cond_curve(quiet.rao_blackwell(keep(_parents(t)), t.draws, t.grid(0, 20, 4), EDGE_STAR, True)))


@query("p14_snapshot_curves", " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS snap_id, {star}e0 AS t_star, T, p, n FROM ({_rb_sql(True).replace(str(EDGE_STAR), str(star))})" for i, star in enumerate((40.0, 50.0, 60.0))))
def _(t):
    snaps = t.spark.createDataFrame([(i, star) for i, star in enumerate((40.0, 50.0, 60.0))], "snap_id int, t_star double")
    return rounded(quiet.snapshot_curves(criteria.mark_roots(t.parents, "parent_id"), t.edges, t.draws, snaps, t.grid(0, 20, 4)))


_STATE = ("state", "SELECT traj_id, coalesce(min(day) FILTER (day > 20 AND day <= 28), 29) AS fa FROM (SELECT traj_id, CAST(greatest(0, least(floor(t), 29)) AS BIGINT) AS day FROM ev WHERE event_type = 'signup') GROUP BY traj_id")


@query("p15_matrix_extinction", with_("ev", "SELECT d, round(CASE WHEN count(fa) FILTER (fa > d) = 0 THEN 1e0 ELSE count(fa) FILTER (fa = 29) / (count(fa) FILTER (fa > d))::DOUBLE END, 6) AS p FROM (SELECT CAST(i AS BIGINT) AS d FROM range(29) r(i)), state GROUP BY d", _STATE))
def _(t):
    return rounded(collect.matrix_extinction(collect.time_matrix(t.ev.filter(SIGNUP), 28, 20), 28))


def _act(t):
    return t.edges.filter(F.col("parent_t") <= EDGE_STAR).select("traj_id", "parent_t")


_AC = ("act", f"SELECT DISTINCT traj_id, parent_t FROM edges WHERE parent_t <= {EDGE_STAR}")
_G5 = ("g", grid_sql(0, 20, 5))


def _bands(df):
    return rounded(percentiles(df, ["T"], "g", {"p": 0.5, "lo": 0.05, "hi": 0.95}))


_BAND = "SELECT T, round(quantile_cont(gg, 0.5), 6) AS p, round(quantile_cont(gg, 0.05), 6) AS lo, round(quantile_cont(gg, 0.95), 6) AS hi FROM (SELECT T, coalesce(gq, 1e0) AS gg FROM (SELECT traj_id, T FROM draws, g) LEFT JOIN q USING (traj_id, T)) GROUP BY T"


def _ev_sql(theta: str = "theta") -> str:
    return with_("draws edges", _BAND, _AC, _G5, ("pf", f"SELECT *, {erlang('age', 'alpha', theta)} AS F0 FROM (SELECT a.traj_id, r * R0 AS R, k, alpha, theta, greatest(0e0, {EDGE_STAR} - parent_t - alpha*theta) AS age FROM act a JOIN draws d ON a.traj_id = d.traj_id)"), ("q", f"SELECT traj_id, T, exp(sum(-k * ln((1+R/k*(1-F0))/(1+R/k*({erlang('(age + T)', 'alpha', theta)}-F0))))) AS gq FROM pf, g GROUP BY traj_id, T"))


@query("p16_lineage_quiet_ev", _ev_sql())
def _(t):
    return _bands(quiet.lineage_quiet(t.draws, _act(t), t.grid(0, 20, 5), EDGE_STAR, "ev"))


@query("p16_lineage_quiet_size", with_("draws edges", _BAND, _AC, _G5, ("q", f"SELECT d.traj_id, T, exp(-k*n*ln((1+r*R0/k)/(1+r*R0*{erlang('T')}/k))) AS gq FROM draws d JOIN (SELECT traj_id, count(*) AS n FROM act GROUP BY traj_id) c ON d.traj_id = c.traj_id, g")))
def _(t):
    return _bands(quiet.lineage_quiet(t.draws, _act(t), t.grid(0, 20, 5), EDGE_STAR, "size_only"))


@query("p17_lineage_quiet_removal", _ev_sql("(theta/(1+0.05*theta))"))
def _(t):
    return _bands(quiet.lineage_quiet_removal(t.draws, _act(t), t.grid(0, 20, 5), EDGE_STAR, "exponential", 0.05))


@query("p17_lineage_quiet_weibull", with_(
    "draws edges", _BAND, _AC, _G5,
    ("ages", f"SELECT DISTINCT a.traj_id, r * R0 AS R, k, alpha, theta, greatest(0e0, {EDGE_STAR} - parent_t - alpha*theta) AS age, parent_t FROM act a JOIN draws d ON a.traj_id = d.traj_id"),
    ("cells", "SELECT *, age + T AS age1 FROM ages, g"),
    ("f0", thinned_sql("age", 0.05, 1.5, 600, "ages")), ("f1", thinned_sql("age1", 0.05, 1.5, 600, "cells")),
    ("q", "SELECT f1.traj_id, f1.T, exp(sum(-f1.k * ln((1+f1.R/f1.k*(1-f0.fx))/(1+f1.R/f1.k*(f1.fx-f0.fx))))) AS gq FROM f1 JOIN f0 ON f0.traj_id = f1.traj_id AND f0.parent_t = f1.parent_t GROUP BY f1.traj_id, f1.T"),
))
def _(t):
    return _bands(quiet.lineage_quiet_removal(t.draws, _act(t), t.grid(0, 20, 5), EDGE_STAR, "weibull", 0.05, 1.5))


_LEVELS = (0.5, 0.8, 0.95)


@query("p16_lineage_quiet_levels", _ev_sql().replace("round(quantile_cont(gg, 0.05), 6) AS lo, round(quantile_cont(gg, 0.95), 6) AS hi", ", ".join(f"round(quantile_cont(gg, {0.5 + s * x / 2}), 6) AS {e}_{round(100 * x)}" for x in _LEVELS for e, s in (("lo", -1), ("hi", 1)))))
def _(t):
    return rounded(quiet.level_bands(quiet.lineage_quiet(t.draws, _act(t), t.grid(0, 20, 5), EDGE_STAR, "ev"), "g", _LEVELS))


@query("p16_lineage_quiet_uncontrolled", _ev_sql().replace("r * R0 AS R", "R0 AS R"))
def _(t):
    return _bands(quiet.lineage_quiet(t.draws, _act(t), t.grid(0, 20, 5), EDGE_STAR, "ev", effective=False))


def _ls_sql(body: str, horizon: float | None) -> str:
    fh = "1e0" if horizon is None else erlang(f"(age + {horizon})")
    return with_("draws edges", body, _AC, _G5, ("pf", f"SELECT *, {erlang('age')} AS F0, {fh} AS Fh FROM (SELECT a.traj_id, r * R0 AS R, k, alpha, theta, {EDGE_STAR} - parent_t AS age FROM act a JOIN draws d ON a.traj_id = d.traj_id)"), ("q", f"SELECT traj_id, T, sum(-k*ln(1+R/k*({erlang('(age + T)')}-F0))) AS ls, sum(-k*ln(1+R/k*(Fh-F0))) AS lh FROM pf, g GROUP BY traj_id, T"), ("lg", "SELECT T, coalesce(ls, 0) AS ls, coalesce(lh, 0) AS lh FROM (SELECT traj_id, T FROM draws, g) LEFT JOIN q USING (traj_id, T)"))


def _logs(t, horizon=None):
    return quiet.log_survival(t.draws, _act(t), t.grid(0, 20, 5), EDGE_STAR, horizon)


@query("p18_first_after", _ls_sql("SELECT T, round(quantile_cont(exp(lh-ls), 0.5), 6) AS p, round(quantile_cont(exp(lh-ls), 0.05), 6) AS lo, round(quantile_cont(exp(lh-ls), 0.95), 6) AS hi FROM lg GROUP BY T", 30.0))
def _(t):
    return rounded(quiet.first_after(_logs(t, 30.0)))


@query("p19_first_after_mixture", _ls_sql("SELECT T, round(sum(exp(lh))/sum(exp(ls)), 6) AS p FROM lg GROUP BY T", None))
def _(t):
    return rounded(quiet.first_after_mixture(_logs(t)))


@query("p20_bootstrap_bands", _ls_sql(
    "SELECT T, round(quantile_cont(p, 0.05), 6) AS lo, round(quantile_cont(p, 0.95), 6) AS hi FROM (SELECT b, T, sum(c * exp(lh)) / sum(c * exp(ls)) AS p FROM (SELECT b, T, ls, lh, "
    + " + ".join(f"(CASE WHEN u >= {float(c)!r} THEN 1 ELSE 0 END)" for c in quiet.POISSON_CUTS)
    + " AS c FROM (SELECT *, CAST(('0x' || substr(md5('11:' || traj_id || ':' || b), 1, 10))::BIGINT AS DOUBLE) / 1099511627776e0 AS u FROM lg, range(50) r(b))) WHERE c > 0 GROUP BY b, T) GROUP BY T", None).replace('lg AS (SELECT T,', 'lg AS (SELECT traj_id, T,'))
def _(t):
    return rounded(quiet.bootstrap_bands(_logs(t), 50, 11))


def _general_gamma(x: str, a: str) -> str:
    """Regularised lower incomplete gamma at any shape, by its series; x / a far beyond the mean is 1."""
    n = f"CAST(least(4000, ceil({x} + 12 * sqrt({x} + {a}) + 60)) AS BIGINT)"
    series = f"list_sum(list_transform(range({n}), lambda j: exp({a} * ln({x}) + j * ln({x}) - {x} - lgamma({a} + j + 1))))"
    return f"(CASE WHEN {x} <= 0 THEN 0e0 WHEN {x} > {a} + 40 * sqrt({a}) + 60 THEN 1e0 ELSE {series} END)"


def _surrogate_sql(method: str, horizon: float | None, rho: float = 3.0) -> str:
    """Hazards from closed forms; moments from incomplete gamma functions at three shapes, as Erlang sums."""
    upper = lambda j: f"(1 - {erlang('age', f'(alpha + {j})')})" if j == 0 else f"(exp(-age / theta) * list_sum(list_transform(range(CAST(alpha + {j} AS BIGINT)), lambda i: pow(age / theta, i) / gamma(i + 1))))"
    gone = lambda b, t: "1e0" if t is None else f"(1 - exp(-({b}) * {t}))"
    gom = lambda t: f"A * {gone('h0 / A', t)}"
    hazard = {
        "gompertz": gom,
        "gamma_moment": lambda t: "A" if t is None else f"A * {_general_gamma(f'({t} / gth)', 'ga')}",
        "two_exp": lambda t: f"CASE WHEN t1 > 0 AND t2 > 0 THEN t1 / b1 * {gone('b1', t)} + t2 / ({rho} * b1) * {gone(f'{rho} * b1', t)} ELSE {gom(t)} END",
    }[method]
    logs = lambda t: f"CASE WHEN A > 0 THEN greatest(-({hazard(t)}), {quiet.LEAST_LOG!r}) ELSE 0e0 END"
    end = None if horizon is None else f"{horizon}e0"
    return with_(
        "draws edges", "SELECT T, round(greatest(0, least(1, sum(exp(lh)) / sum(exp(ls)))), 6) AS p FROM sur GROUP BY T", _AC, _G5,
        ("ages", f"SELECT a.traj_id, r * R0 AS R, k, CAST(alpha AS DOUBLE) AS alpha, theta, {EDGE_STAR} - parent_t AS age FROM act a JOIN draws d ON a.traj_id = d.traj_id"),
        ("dens", f"SELECT *, {_pdf('age')} AS f, {upper(0)} AS q0, {upper(1)} AS q1, {upper(2)} AS q2 FROM ages"),
        ("mom", "SELECT *, f * ((alpha - 1) / greatest(age, 1e-300) - 1 / theta) AS df, theta * alpha * q1 AS e1, theta * theta * alpha * (alpha + 1) * q2 AS e2 FROM dens"),
        ("sums", "SELECT traj_id, sum(k * ln(1 + R / k * q0)) AS A, sum(R * f) AS h0, sum(R * df - R * R / k * f * f) AS h1, sum(R * (e1 - age * q0)) AS m1, sum(R * (e2 - 2 * age * e1 + age * age * q0)) AS m2 FROM mom GROUP BY traj_id"),
        ("own", "SELECT d.traj_id, coalesce(A, 0e0) AS A, h0, h1, m1 / A AS mu, greatest(m2 / A - (m1 / A) * (m1 / A), 1e-12) AS va FROM draws d LEFT JOIN sums s ON d.traj_id = s.traj_id"),
        ("par", f"SELECT *, greatest(mu * mu / va, 1e-9) AS ga, greatest(va / greatest(mu, 1e-12), 1e-9) AS gth, CASE WHEN pow(h0 * {rho + 1}, 2) + 4 * {rho} * A * h1 >= 0 THEN (h0 * {rho + 1} + sqrt(greatest(0e0, pow(h0 * {rho + 1}, 2) + 4 * {rho} * A * h1))) / (2 * {rho} * A) END AS b1 FROM own"),
        ("two", f"SELECT *, CASE WHEN b1 > 0 THEN -(h0 + h1 / b1) / {rho - 1} END AS t2 FROM par"),
        ("ends", "SELECT *, h0 - t2 AS t1 FROM two"),
        ("last", f"SELECT *, {logs(end)} AS lh FROM ends"),
        ("sur", f"SELECT T, lh, {logs('T')} AS ls FROM last, g"),
    )


for _m in ("exact", "gompertz", "two_exp", "gamma_moment"):
    for _end in (None, 30.0):

        @query(f"p21_surrogate_{_m}" + ("_finite" if _end else ""), _ls_sql("SELECT T, round(sum(exp(lh))/sum(exp(ls)), 6) AS p FROM lg GROUP BY T", _end) if _m == "exact" else _surrogate_sql(_m, _end))
        def _(t, m=_m, end=_end):
            return rounded(quiet.first_after_surrogate(t.draws, _act(t), t.grid(0, 20, 5), EDGE_STAR, m, end))


@query("p22_parametric_quiet", with_("parents edges draws", "SELECT T, round(quantile_cont(gq, 0.5), 6) AS p, count(*) AS n FROM (SELECT traj_id, T, exp(sum((k+n_pre)*ln((k/Reff+" + erlang("(age + T)") + ")/(k/Reff+1)))) AS gq FROM pp, g GROUP BY traj_id, T) GROUP BY T", *_PAR))
def _(t):
    return rounded(quiet.parametric_quiet(_parents(t), t.draws, t.grid(0, 20, 4), EDGE_STAR))


_CHILD = ("fp", f"SELECT c.traj_id, min(child_t) FILTER (child_t > {EDGE_STAR}) - {EDGE_STAR} AS first_post, max(child_t) AS last_t FROM customers c LEFT JOIN edges e ON c.traj_id = e.traj_id GROUP BY c.traj_id")
_QUIET = "SELECT T, round(count(*) FILTER (first_post IS NULL) / nullif(count(*) FILTER (first_post IS NULL OR first_post > T), 0)::DOUBLE, 6) AS p FROM fp, g GROUP BY T"
_COMPARED = {
    ("unconditional", "empirical"): with_("customers edges", f"SELECT T, round(avg(CASE WHEN last_t IS NULL OR last_t <= {EDGE_STAR} + T THEN 1e0 ELSE 0e0 END), 6) AS p FROM fp, g GROUP BY T", _CHILD, ("g", grid_sql(0, 20, 4))),
    ("conditional", "empirical"): with_("customers edges", _QUIET, _CHILD, ("g", grid_sql(0, 20, 4))),
    ("unconditional", "seeds"): _seed_sql(4),
    ("conditional", "seeds"): with_("customers edges", _QUIET, _SEED, ("g", grid_sql(0, 20, 4))),
    ("unconditional", "rao_blackwell"): _uncond_sql(),
    ("conditional", "rao_blackwell"): _rb_sql(True),
}


@query("p23_compare_estimators", " UNION ALL ".join(f"SELECT '{target}' AS target, '{name}' AS estimator, T, p FROM ({sql})" for (target, name), sql in _COMPARED.items()))
def _(t):
    g = t.grid(0, 20, 4)
    ev = t.edges.select("traj_id", F.col("child_t").alias("t"))
    p11 = quiet.rb_uncond(_parents(t), t.draws, [float(x) for x in range(0, 21, 4)], EDGE_STAR).groupBy("T").agg(F.avg("g").alias("p"))
    tables = {
        ("unconditional", "empirical"): quiet.empirical_uncond(t.customers, ev, g, EDGE_STAR),
        ("conditional", "empirical"): quiet.empirical_cond(t.customers, ev, g, EDGE_STAR),
        ("unconditional", "seeds"): quiet.seed_uncond(t.draws, t.edges, g, EDGE_STAR),
        ("conditional", "seeds"): quiet.seed_cond(t.customers, t.edges, g, EDGE_STAR),
        ("unconditional", "rao_blackwell"): p11,
        ("conditional", "rao_blackwell"): quiet.rb_cond_curve(quiet.rao_blackwell(_parents(t), t.draws, g, EDGE_STAR, True)),
    }
    return rounded(quiet.compare_estimators(tables))

