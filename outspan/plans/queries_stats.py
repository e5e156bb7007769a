"""Queries: posterior summaries, intervals, weighted bands, densities, goodness of fit."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.special import gamma_cdf
from ..operators import criteria, stats
from ..sources import ingest
from .bindings import T_STAR, erlang, grid_sql, with_
from .register import registry, rounded

QUERIES, ORACLE, query = registry()
LONG = ("long", "SELECT traj_id, 'R0' AS metric, R0 AS value FROM draws UNION ALL SELECT traj_id, 'k', k FROM draws UNION ALL SELECT traj_id, 'theta', theta FROM draws")
M3 = ["R0", "k", "theta"]


def _long(t):
    return stats.to_long(t.draws, ["traj_id"], M3)


def hdi_sql(source: str, keys: str, value: str, offset: str) -> str:
    """Shortest interval by ranks, one row a key."""
    return f"SELECT {keys}, arg_min(a, row(b - a, rn)) AS lo, arg_min(b, row(b - a, rn)) AS hi FROM (SELECT x.{keys}, x.rn, x.v AS a, y.v AS b FROM rk_{value} x JOIN rk_{value} y ON x.{keys} = y.{keys} AND y.rn = x.rn + {offset}) GROUP BY {keys}"


def ranks(source: str, keys: str, value: str) -> tuple[str, str]:
    return (f"rk_{value}", f"SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}")


def _off(mass: float) -> str:
    return f"(CASE WHEN x.n = 1 THEN 0 ELSE least(greatest(floor(x.n * {mass}::DOUBLE), 1), x.n - 1) END)"


@query("f7_summary_row", with_("draws", f"SELECT s.metric, n, round(median, 6) AS median, round(l, 6) AS et_lo_50, round(h, 6) AS et_hi_50, round(lo, 6) AS hdi_lo_50, round(hi, 6) AS hdi_hi_50 FROM (SELECT metric, count(*) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS l, quantile_cont(value, 0.75) AS h FROM long GROUP BY metric) s JOIN ({hdi_sql('long', 'metric', 'value', _off(0.5))}) q ON s.metric = q.metric", LONG, ranks("long", "metric", "value")))
def _(t):
    return rounded(stats.summary_row(_long(t), ["metric"], "value", (0.5,)))


_NB = lambda n: "pow(k/(k+R0),k)" + "".join(f"*(k+{i - 1}e0)/{i}e0*(R0/(k+R0))" for i in range(1, n + 1))
_METRIC_SQL = {
    "R0": "R0", "k": "k", "r": "r", "alpha": "alpha::DOUBLE", "theta": "theta", "Re": "r*R0", "reduction": "1-r", "gt_mean": "alpha*theta",
    "gt_sd": "sqrt(alpha)*theta", "gt_cv": "1/sqrt(alpha)", "gt_mode": "(alpha-1)*theta", "R0_k": "R0/k", "Re_k": "r*R0/k", "p0": "pow(k/(k+r*R0+1e-12),k)",
    "growth": "(pow(R0,1e0/alpha)-1)/theta", "elasticity": "alpha*(pow(R0,1e0/alpha)-1)", "p_ge_5": "1-(" + "+".join(_NB(i) for i in range(5)) + ")",
    "p_ge_10": "1-(" + "+".join(_NB(i) for i in range(10)) + ")", "p_1_4": "+".join(_NB(i) for i in range(1, 5)),
}


def _posterior_sql(masses: tuple[float, ...]) -> str:
    """Quantiles and shortest intervals of all metrics in one row each."""
    et = ", ".join(f"round(quantile_cont(value, {(1 - m) / 2}), 6) AS et_lo_{round(m * 100)}, round(quantile_cont(value, {(1 + m) / 2}), 6) AS et_hi_{round(m * 100)}" for m in masses)
    short = ", ".join(f"round(q{i}.lo, 6) AS hdi_lo_{round(m * 100)}, round(q{i}.hi, 6) AS hdi_hi_{round(m * 100)}" for i, m in enumerate(masses))
    joins = " ".join(f"JOIN ({hdi_sql('every', 'metric', 'value', _off(m))}) q{i} ON q{i}.metric = s.metric" for i, m in enumerate(masses))
    every = " UNION ALL ".join(f"SELECT '{name}' AS metric, CAST({sql} AS DOUBLE) AS value FROM draws" for name, sql in _METRIC_SQL.items())
    body = f"SELECT s.*, {short}, (SELECT round(avg(CASE WHEN r*R0 < 1 THEN 1e0 ELSE 0e0 END), 6) FROM draws) AS p_re_below_1 FROM (SELECT metric, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, {et} FROM every GROUP BY metric) s {joins}"
    return with_("draws", body, ("every", every), ranks("every", "metric", "value"))


@query("f8_posterior_table", _posterior_sql((0.5, 0.95)))
def _(t):
    return rounded(stats.posterior_table(t.draws))


SPECS = {"all": [], "low": ["R0 < 6"], "short": ["alpha * theta < 12"]}
_SPEC = ("sp", "SELECT 'all' AS spec, * FROM draws UNION ALL SELECT 'low', * FROM draws WHERE R0 < 6 UNION ALL SELECT 'short', * FROM draws WHERE alpha * theta < 12")
_SUM = ("sm", "SELECT spec, metric, count(*) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.025) AS q025, quantile_cont(value, 0.975) AS q975 FROM (SELECT spec, 'R0' AS metric, R0 AS value FROM sp UNION ALL SELECT spec, 'k', k FROM sp UNION ALL SELECT spec, 'theta', theta FROM sp) GROUP BY ALL")


def _sweep(t):
    from ..operators.windows import spec_sweep

    return stats.spec_summary(spec_sweep(t.draws, SPECS), M3)


@query("f9_spec_summary", with_("draws", "SELECT spec, metric, n, round(median, 6) AS median, round(q025, 6) AS q025, round(q975, 6) AS q975 FROM sm", _SPEC, _SUM))
def _(t):
    return rounded(_sweep(t))


@query("f9_spec_wide", with_("draws", "SELECT spec, round(max(median) FILTER (metric='R0'), 6) AS R0, round(max(median) FILTER (metric='k'), 6) AS k, round(max(median) FILTER (metric='theta'), 6) AS theta FROM sm GROUP BY spec", _SPEC, _SUM))
def _(t):
    return rounded(stats.spec_wide(_sweep(t), M3))


@query("f10_delta_to_baseline", with_("draws", "SELECT s.spec, s.metric, round(s.median - b.median, 6) AS delta FROM sm s LEFT JOIN sm b ON s.metric = b.metric AND b.spec = 'all'", _SPEC, _SUM))
def _(t):
    return rounded(stats.delta_to_baseline(_sweep(t), "all").select("spec", "metric", "delta"))


@query("f11_quiet_spec_summary", with_("ev draws entities", f"SELECT spec, metric, n, round(median, 6) AS median FROM sm", ("q", f"SELECT * FROM draws WHERE traj_id NOT IN (SELECT traj_id FROM ev WHERE event_type='signup' AND t > {T_STAR} AND t <= {T_STAR}+2)"), ("sp", "SELECT 'all' AS spec, * FROM q UNION ALL SELECT 'low', * FROM q WHERE R0 < 6 UNION ALL SELECT 'short', * FROM q WHERE alpha * theta < 12"), _SUM))
def _(t):
    from ..operators.windows import spec_sweep

    quiet = criteria.quiet_for(t.draws, t.ev.filter("event_type = 'signup'"), T_STAR, 2.0)
    return rounded(stats.spec_summary(spec_sweep(quiet, SPECS), M3).select("spec", "metric", "n", "median"))


@query("f12_interval_report", with_("draws", f"SELECT metric, round(lo, 6) AS lo, round(hi, 6) AS hi, round((lo+hi)/2-(hi-lo)/2*1.2, 6) AS wide_lo, round((lo+hi)/2+(hi-lo)/2*1.2, 6) AS wide_hi FROM ({hdi_sql('long', 'metric', 'value', _off(0.8))})", LONG, ranks("long", "metric", "value")))
def _(t):
    return rounded(stats.interval_report(t.draws, M3))


@query("f15_metric_bounds", with_("draws", "SELECT metric, round(a-0.08*(b-a), 6) AS lo, round(b+0.08*(b-a), 6) AS hi FROM (SELECT metric, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM long GROUP BY metric)", LONG))
def _(t):
    return rounded(stats.metric_bounds(_long(t), ["metric"], "value"))


@query("f16_prob_true", with_("draws", "SELECT round(avg(CASE WHEN R0 * r < 1 THEN 1e0 ELSE 0e0 END), 6) AS p FROM draws"))
def _(t):
    return rounded(stats.prob_true(t.draws, "R0 * r < 1"))


@query("g1_hdi", with_("draws", f"SELECT alpha, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ({hdi_sql('draws', 'alpha', 'R0', _off(0.9))})", ranks("draws", "alpha", "R0")))
def _(t):
    return rounded(stats.hdi(t.draws, ["alpha"], "R0", 0.9))


@query("g2_pointwise_hpd", with_("draws", f"SELECT alpha, round(greatest(lo, 0), 6) AS lo, round(least(hi, 1), 6) AS hi FROM ({hdi_sql('draws', 'alpha', 'r', '(greatest(1, floor(x.n * 0.9::DOUBLE)) - 1)')})", ranks("draws", "alpha", "r")))
def _(t):
    return rounded(stats.pointwise_hpd(t.draws, ["alpha"], "r", 0.9))


_CUMW = ("cw", "SELECT alpha, R0, w, sum(w) OVER (PARTITION BY alpha ORDER BY R0) AS cum, sum(w) OVER (PARTITION BY alpha) AS total FROM (SELECT alpha, R0, sum(k) AS w FROM draws GROUP BY ALL)")


@query("g3_weighted_quantile", with_("draws", "SELECT alpha, round(min(R0) FILTER (cum >= 0.3*total - 1e-12), 6) AS quantile FROM cw GROUP BY alpha", _CUMW))
def _(t):
    return rounded(stats.weighted_quantile(t.draws, ["alpha"], "R0", "k", 0.3))


_SH = 0.9**0.7


@query("g4_weighted_tail_mean_band", with_("draws", f"SELECT alpha, round(m, 6) AS mean, round(m+(l-m)*{_SH}, 6) AS lo, round(m+(h-m)*{_SH}, 6) AS hi FROM (SELECT alpha, sum(R0*w)/sum(w) AS m, sum(R0*w) FILTER (cum <= total*0.05 OR R0 = a)/sum(w) FILTER (cum <= total*0.05 OR R0 = a) AS l, sum(R0*w) FILTER (cum >= total - total*0.05 OR R0 = z)/sum(w) FILTER (cum >= total - total*0.05 OR R0 = z) AS h FROM (SELECT *, min(R0) OVER (PARTITION BY alpha) AS a, max(R0) OVER (PARTITION BY alpha) AS z FROM cw) GROUP BY alpha)", _CUMW))
def _(t):
    return rounded(stats.weighted_tail_mean_band(t.draws, ["alpha"], "R0", "k", 0.9))


@query("g5_weighted_mean", with_("draws", "SELECT alpha, round(sum(R0*k)/sum(k), 6) AS mean FROM draws GROUP BY alpha"))
def _(t):
    return rounded(stats.weighted_mean(t.draws, ["alpha"], "R0", "k"))


_REP = ("rep", "SELECT alpha, (floor(R0)+0.5e0) AS c FROM draws")


@query("g6_binned_stats", with_("draws", "SELECT alpha, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.05), 6) AS lo, round(quantile_cont(c, 0.95), 6) AS hi FROM rep GROUP BY alpha", _REP))
def _(t):
    h = t.draws.groupBy("alpha", (F.floor("R0") + 0.5).alias("centre")).agg(F.count("*").alias("n"))
    return rounded(stats.binned_stats(h, ["alpha"], 0.9))


@query("g6_binned_shortest", with_("draws", f"SELECT alpha, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ({hdi_sql('rep', 'alpha', 'c', _off(0.9))})", _REP, ranks("rep", "alpha", "c")))
def _(t):
    h = t.draws.groupBy("alpha", (F.floor("R0") + 0.5).alias("centre")).agg(F.count("*").alias("n"))
    return rounded(stats.binned_stats(h, ["alpha"], 0.9, "shortest").select("alpha", "lo", "hi"))


@query("g7_equal_tailed", with_("draws", "SELECT alpha, round(quantile_cont(R0, 0.025), 6) AS q025, round(quantile_cont(R0, 0.975), 6) AS q975 FROM draws GROUP BY alpha"))
def _(t):
    return rounded(stats.equal_tailed(t.draws, ["alpha"], "R0", (0.025, 0.975)))


_CRV = ("cv", "SELECT traj_id, x, exp(-R0*x/10) AS y FROM draws, (SELECT unnest([0e0,1e0,2e0,3e0]) AS x)")


@query("g8_simultaneous_band", with_("draws", "SELECT x, round(mean, 6) AS mean, round(greatest(mean-c*sd, 0), 6) AS lo, round(least(mean+c*sd, 1), 6) AS hi, round(cov, 6) AS coverage FROM m, (SELECT max(c) AS c, avg(CASE WHEN worst <= c THEN 1e0 ELSE 0e0 END) AS cov FROM z, (SELECT quantile_cont(worst, 0.9) AS c FROM z))", _CRV, ("m", "SELECT x, avg(y) AS mean, greatest(stddev_samp(y), 1e-9) AS sd FROM cv GROUP BY x"), ("z", "SELECT traj_id, max(abs(y-mean)/sd) AS worst FROM cv JOIN m USING (x) GROUP BY traj_id")))
def _(t):
    x = t.spark.sql("SELECT explode(array(0e0, 1e0, 2e0, 3e0)) AS x")
    c = t.draws.crossJoin(F.broadcast(x)).select("traj_id", "x", F.exp(-F.col("R0") * F.col("x") / 10).alias("y"))
    out = stats.simultaneous_band(c, "traj_id", "x", "y", 0.9)
    # At x = 0 all curves agree: deviations there are rounding noise over the floor of the spread.
    return rounded(out)


def _kde_sql(bw: str, kern: str, src: str = "SELECT alpha, R0 AS v FROM draws", weight: str = "1", inside: str = "true", of: str = "draws") -> str:
    return with_("draws", "SELECT alpha, x, round(CASE WHEN area > 0 THEN d/area ELSE d END, 6) AS density FROM (SELECT *, sum(a) OVER (PARTITION BY alpha) AS area FROM (SELECT alpha, x, d, (x - lag(x) OVER w)*(d + lag(d) OVER w)/2 AS a FROM dens WHERE i WINDOW w AS (PARTITION BY alpha ORDER BY x))) UNION ALL SELECT alpha, x, 0e0 FROM dens WHERE NOT i", ("sm", src), ("b", f"SELECT alpha, {bw} AS bw, count(*) AS n FROM {of} GROUP BY alpha"), ("g", grid_sql(-2, 18, 0.5, "x")), ("dens", f"SELECT sm.alpha, x, CASE WHEN {inside} THEN sum({weight} * {kern})/max(n*bw) ELSE 0 END AS d, {inside} AS i FROM sm JOIN b ON sm.alpha = b.alpha, g GROUP BY sm.alpha, x"))


_GK = f"exp(-0.5*pow((x-v)/bw,2))/{math.sqrt(2 * math.pi)!r}"
_SCOTT = "stddev_samp(R0)*pow(count(*)::DOUBLE,-0.2)"
_SILV = "0.9*least(stddev_pop(R0),(quantile_cont(R0,0.75)-quantile_cont(R0,0.25))/1.34)*pow(count(*)::DOUBLE,-0.2)"


@query("g9_kde_gaussian", _kde_sql(_SCOTT, _GK))
def _(t):
    return rounded(stats.kde(t.draws, ["alpha"], "R0", t.grid(-2, 18, 0.5, "x")))


_NODES = f"SELECT alpha, (j + o) * dl AS v, sum(CASE WHEN o = 0 THEN 1 - f ELSE f END) AS w FROM (SELECT alpha, dl, floor(R0/dl) AS j, R0/dl - floor(R0/dl) AS f FROM draws JOIN (SELECT alpha, {_SCOTT}/512 AS dl FROM draws GROUP BY alpha) USING (alpha)), (SELECT unnest([0, 1]) AS o) GROUP BY ALL"


@query("g9_kde_binned", _kde_sql(_SCOTT, _GK, _NODES, "w"))
def _(t):
    return rounded(stats.kde(t.draws, ["alpha"], "R0", t.grid(-2, 18, 0.5, "x"), per_bandwidth=512))


@query("g10_kde_epanechnikov", _kde_sql(_SILV, "(CASE WHEN abs((x-v)/bw) <= 1 THEN 0.75*(1-pow((x-v)/bw,2)) ELSE 0e0 END)"))
def _(t):
    return rounded(stats.kde(t.draws, ["alpha"], "R0", t.grid(-2, 18, 0.5, "x"), "silverman", "epanechnikov"))


_MIRROR = "SELECT alpha, R0 AS v FROM draws UNION ALL SELECT alpha, -R0 FROM draws d JOIN near USING (alpha) WHERE -R0 > -far UNION ALL SELECT alpha, 30-R0 FROM draws d JOIN near USING (alpha) WHERE 30-R0 < 15 + far"


@query("g11_kde_reflected", _kde_sql(_SCOTT.replace("R0", "v"), _GK, _MIRROR, "1", "x BETWEEN 0 AND 15", "sm").replace("sm AS (", "near AS (SELECT alpha, 0.4*(max(R0)-min(R0)) AS far FROM draws GROUP BY alpha),\nsm AS (", 1))
def _(t):
    return rounded(stats.kde(t.draws, ["alpha"], "R0", t.grid(-2, 18, 0.5, "x"), bounds=(0.0, 15.0), method="reflect"))


def _normal_sql(z: str) -> str:
    """The normal distribution by the series of its error function; beyond 7 deviations it is 0 or 1."""
    terms = f"list_sum(list_transform(range(150), lambda j: exp(j * ln(2e0) + (2 * j + 1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2 * j + 2) - j * ln(2e0) - lgamma(j + 1)) - j * ln(2e0))))"
    return f"(CASE WHEN {z} > 7 THEN 1e0 WHEN {z} < -7 THEN 0e0 ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r} * {terms} END)"


@query("g12_kde_truncated", _kde_sql(_SCOTT, _GK, "SELECT d.alpha, R0 AS v, " + _normal_sql("((15 - R0) / s)") + " - " + _normal_sql("(-R0 / s)") + f" AS mass FROM draws d JOIN (SELECT alpha, {_SCOTT} AS s FROM draws GROUP BY alpha) w ON d.alpha = w.alpha", "1/greatest(mass, 1e-15)", "x BETWEEN 0 AND 15"))
def _(t):
    return rounded(stats.kde(t.draws, ["alpha"], "R0", t.grid(-2, 18, 0.5, "x"), bounds=(0.0, 15.0), method="truncate"))


@query("g13_bandwidth", with_("draws", f"SELECT alpha, round({_SILV}, 6) AS bw, count(*) AS n FROM draws GROUP BY alpha"))
def _(t):
    return rounded(stats.bandwidth(t.draws, ["alpha"], "R0", "silverman"))


@query("g14_fd_bins", with_("draws", "SELECT alpha, CAST(least(greatest(ceil((max(R0)-min(R0))/(2*(quantile_cont(R0,0.75)-quantile_cont(R0,0.25))*pow(count(*)::DOUBLE,-1e0/3))),30),120) AS BIGINT) AS bins FROM draws GROUP BY alpha"))
def _(t):
    return stats.fd_bins(t.draws, ["alpha"], "R0")


@query("g15_fit_r1", with_("draws", "SELECT round(1-sum(pow(d-p,2))/(sum(d*d)-sum(d)*sum(d)/count(*)), 6) AS r1 FROM (SELECT d, exp(-0.5*pow((c-mu)/sd,2))/(sd*2.5066282746310002) AS p FROM (SELECT (b.bin+0.5e0)*0.3e0 AS c, coalesce(n,0)/(sum(n) OVER ()*0.3e0) AS d FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN (SELECT CAST(least(floor((R0*r)/6e0*20), 19) AS BIGINT) AS bin, count(*) AS n FROM draws WHERE R0*r BETWEEN 0 AND 6 GROUP BY 1) h ON b.bin = h.bin), (SELECT avg(R0*r) AS mu, stddev_pop(R0*r) AS sd FROM draws))"))
def _(t):
    return rounded(stats.fit_r1(t.draws.withColumn("Re", F.expr("R0 * r")), "Re", "normal", 20, 0.0, 6.0))


@query("g16_ks_distance", with_("ev", "SELECT event_type, round(max(abs(rn/n::DOUBLE - least(t/30,1))), 6) AS ks, round(1.63/sqrt(max(n)), 6) AS critical FROM (SELECT event_type, t, row_number() OVER (PARTITION BY event_type ORDER BY t) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM ev) GROUP BY event_type"))
def _(t):
    return rounded(stats.ks_distance(t.ev, ["event_type"], "t", F.least(F.col("t") / 30, F.lit(1.0))))


@query("g16_ks_gamma", with_("draws", f"SELECT alpha, round(max(abs(rn/n::DOUBLE - F)), 5) AS ks, round(1.63/sqrt(max(n)), 5) AS critical FROM (SELECT alpha, {erlang('theta', '4', '1.5e0')} AS F, row_number() OVER (PARTITION BY alpha ORDER BY theta) AS rn, count(*) OVER (PARTITION BY alpha) AS n FROM draws) GROUP BY alpha"))
def _(t):
    return rounded(stats.ks_distance(t.draws.select("alpha", "theta"), ["alpha"], "theta", gamma_cdf("theta", F.lit(4.0), F.lit(1.5))), 5)


_NB = "pow(4e0/9, 4) * exp(lgamma(value+4)-lgamma(4)-lgamma(value+1)) * pow(5e0/9, value)"


@query("g17_chi2_gof", with_("edges", f"SELECT round(sum(CASE WHEN e > 0 THEN pow(o-e,2)/e END), 4) AS chi2, count(*) AS cells FROM (SELECT CASE WHEN e < 5 THEN 'tail' ELSE CAST(value AS VARCHAR) END AS cell, sum(n) AS o, sum(e) AS e FROM (SELECT value, n, sum(n) OVER () * {_NB} AS e FROM (SELECT value, count(*) AS n FROM (SELECT traj_id, CAST(floor(count(*)/4) AS BIGINT) AS value FROM edges GROUP BY traj_id) GROUP BY value)) GROUP BY 1)"))
def _(t):
    c = t.edges.groupBy("traj_id").agg(F.floor(F.count("*") / 4).cast("long").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    top = c.agg(F.sum("n").alias("total"))
    rec = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("value").cast("int"), F.lit(1))), F.lit((4 / 9) ** 4), lambda p, i: F.when(i <= F.col("value"), p * (i + 3.0) / i * (5 / 9)).otherwise(p))
    return rounded(stats.chi2_gof(c.crossJoin(F.broadcast(top)).withColumn("e", F.col("total") * rec)), 4)


@query("g18_moments", with_("ev", "SELECT event_type, round(avg(t), 6) AS mean, round(var_pop(t), 6) AS var FROM ev GROUP BY event_type"))
def _(t):
    return rounded(stats.moments(t.ev, ["event_type"], "t"))


def _permuted(x: str, n: str, i: int, chunk: str, seed: int = 1) -> str:
    """The permutation by rounds of swaps; n may be an expression."""
    k = f"(('0x' || substr(md5('{seed}:' || q), 1, 10))::HUGEINT * {n} // 1099511627776)::BIGINT"
    other = f"(({k} - v + {n}) % {n})"
    return f"list_reduce(list_prepend({x}, range({ingest.SWAPS})), lambda v, q: CASE WHEN substr(md5('{seed}:{i}:' || {chunk} || ':' || q || ':' || greatest(v, {other})), 1, 1) >= '8' THEN {other} ELSE v END)"


def _stratum(i: int, name: str, lo: float, hi: float, row: str = "rank", n: str = "total", chunk: str = "0") -> str:
    u = f"CAST(('0x' || substr(md5('2:{i}:' || traj_id), 1, 10))::BIGINT AS DOUBLE) / 1099511627776e0"
    return f"{lo} + ({_permuted(row, n, i, chunk)} + {u}) / {n} * ({hi} - {lo}) AS {name}"


_RANGES = [("R0", "0.25e0", "15e0"), ("k", "0.2e0", "10e0"), ("r", "0.01e0", "0.99e0"), ("alpha", "1e0", "4e0"), ("theta", "1e0", "11e0")]
_FIVE = "traj_id, round(R0, 6) AS R0, round(k, 6) AS k, round(r, 6) AS r, round(alpha, 6) AS alpha, round(theta, 6) AS theta"


def _priors():
    from ..model import Parameter

    return [Parameter(name, float(lo), float(hi)) for name, lo, hi in _RANGES]


_RANKED = ("ranked", "SELECT traj_id, row_number() OVER (ORDER BY substr(md5('1:' || traj_id), 1, 10), traj_id) - 1 AS rank, count(*) OVER () AS total FROM customers")


@query("i6_latin_hypercube", with_("customers", f"SELECT {_FIVE} FROM (SELECT traj_id, " + ", ".join(_stratum(i, *p) for i, p in enumerate(_RANGES)) + " FROM ranked)", _RANKED))
def _(t):
    return rounded(ingest.latin_hypercube_of(t.customers, _priors()).drop("chunk"))


@query("n3_rejection_sampler", with_(
    "customers", f"SELECT {_FIVE} FROM (SELECT *, row_number() OVER (ORDER BY traj_id) AS place FROM drawn WHERE R0 * r < 3 AND alpha * theta < 28) WHERE place <= (SELECT count(*) FROM customers)",
    ("numbers", "SELECT unnest(range((SELECT count(*) FROM customers) * 8 + 4000)) AS traj_id"),
    ("drawn", "SELECT traj_id, " + ", ".join(_stratum(i, *p, row="traj_id % 500", n="500", chunk="(traj_id // 500)") for i, p in enumerate(_RANGES)) + " FROM numbers"),
))
def _(t):
    from ..model import Parameters

    wanted = Parameters({p.name: p for p in _priors()}).require("R0 * r < 3").require("alpha * theta < 28")
    return rounded(ingest.sample_valid(t.spark, wanted, t.customers.count(), chunk=500).drop("chunk"))
