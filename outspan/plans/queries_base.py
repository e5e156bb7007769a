"""Queries: ingestion, expressions, filters, joins, collectors and curves."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import special as S
from ..operators import collect, criteria, curves, quiet, spatial
from ..operators.criteria import IntervalCriterion
from ..sources import ingest
from .bindings import DUCK, EDGE_STAR, T_STAR, erlang, grid_sql, thinned_sql, with_
from .register import registry, rounded

QUERIES, ORACLE, query = registry()
R = lambda e, a=None: f"round({e}, 6) AS {a or e}"
Z = X.z_value(0.1)
ROOTED = ("rooted", "SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t, event_id) = 1 AS is_root FROM ev")


@query("a2_observations", with_("observations", "SELECT series_id, ts, CAST(n AS BIGINT) AS n FROM observations WHERE n > 0"))
def _(t):
    return ingest.observations(t.observations).select("series_id", "ts", "n")


@query("a3_draws_table", with_("draws", f"SELECT traj_id, {R('R0')}, {R('k')}, {R('r')}, alpha, {R('theta')} FROM draws WHERE R0 * r < 3 AND alpha * theta < 28"))
def _(t):
    return rounded(X.prior_validator(t.draws, ["R0 * r < 3", "alpha * theta < 28"]))


@query("a4_event_arrays", with_("ev", "SELECT traj_id, len(list(t)) AS n, round(list_sum(list(t)), 4) AS total, round(min(t), 6) AS first FROM ev GROUP BY traj_id"))
def _(t):
    a = ingest.event_arrays(t.ev)
    return a.select("traj_id", F.size("times").cast("long").alias("n"), F.round(F.aggregate("times", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.get("times", F.lit(0)), 6).alias("first"))


@query("a5_edge_log", with_("edges", f"SELECT traj_id, child_id, {R('parent_t')}, {R('child_t')} FROM edges WHERE parent_t <= {EDGE_STAR}"))
def _(t):
    return rounded(ingest.edge_log(t.edges, EDGE_STAR).select("traj_id", "child_id", "parent_t", "child_t"))


@query("a8_decode_optimizer_rows", "SELECT c_custkey, round(c_acctbal / 100, 6) AS objective, CAST(round(c_custkey * 1.25e0) AS BIGINT) AS accepted, CAST(round(c_custkey % 5) AS BIGINT) AS kmax, c_custkey % 2 >= 0.5 AS include_gap_windows FROM customer")
def _(t):
    f = [F.col("c_acctbal") / 100, F.col("c_custkey") * 1.25, *[F.lit(1.0)] * 5, F.col("c_custkey") % 5, *[F.lit(0.1)] * 4, F.col("c_custkey") % 2, *[F.lit(1.0)] * 4]
    rows = t.raw("customer").select("c_custkey", F.array(*[c.cast("double") for c in f]).alias("fields"))
    return rounded(ingest.decode_optimizer_rows(rows).select("c_custkey", "objective", "accepted", "kmax", "include_gap_windows"))


@query("b1_eval_expr", with_("draws", f"SELECT traj_id, {R('pow(R0, 2) * r / (alpha + theta)', 'v')} FROM draws"))
def _(t):
    return rounded(X.eval_expr(t.draws, "v", "power(R0, 2) * r / (alpha + theta)").select("traj_id", "v"))


@query("b2_derived_metrics", with_("draws", f"SELECT traj_id, {R('r*R0','Re')}, {R('1-r','reduction')}, {R('alpha*theta','gt_mean')}, {R('sqrt(alpha)*theta','gt_sd')}, {R('1/sqrt(alpha)','gt_cv')}, {R('(alpha-1)*theta','gt_mode')}, {R('R0/k','R0_k')}, {R('r*R0/k','Re_k')}, {R('pow(k/(k+r*R0+1e-12),k)','p0')}, {R('(pow(R0,1e0/alpha)-1)/theta','growth')}, {R('alpha*(pow(R0,1e0/alpha)-1)','elasticity')} FROM draws"))
def _(t):
    return rounded(X.derived_metrics(t.draws).drop("R0", "k", "r", "alpha", "theta"))


_PMF = lambda n: f"exp(lgamma({n}+k)-lgamma(k)-lgamma({n}+1)+k*ln(k/(k+R0))+{n}*ln(R0/(k+R0)))"


@query("b3_negative_binomial", with_("draws", f"SELECT traj_id, {R(_PMF(3), 'pmf3')}, {R('pow(k/(k+R0),k)', 'p_zero')}, {R('1-' + '-'.join(_PMF(i) for i in range(3)), 'tail3')}, {R('+'.join(_PMF(i) for i in range(1, 5)), 'between')} FROM draws"))
def _(t):
    return rounded(t.draws.select("traj_id", X.nb_pmf(3, "R0", "k").alias("pmf3"), X.nb_p_zero("R0", "k").alias("p_zero"), X.nb_tail_ge(3, "R0", "k").alias("tail3"), X.nb_between(1, 4, "R0", "k").alias("between")))


@query("b7_gamma_kernels", with_("draws", f"SELECT traj_id, {R('exp((alpha-1)*ln(R0)-R0/theta-lgamma(alpha)-alpha*ln(theta))', 'pdf')}, {R(erlang('R0'), 'cdf')}, 0.5e0 AS median_back FROM draws"))
def _(t):
    a = F.col("alpha").cast("double")
    d = t.draws.select("traj_id", S.gamma_pdf("R0", a, "theta").alias("pdf"), S.gamma_cdf("R0", a, "theta").alias("cdf"), S.gamma_cdf(S.gamma_quantile(F.lit(0.5), a, "theta"), a, "theta").alias("median_back"))
    return rounded(d)


@query("b11_days", "SELECT o_orderkey, round((epoch_us(o_orderdate::TIMESTAMP) + o_orderkey % 100 * 864000000 - epoch_us(TIMESTAMP '1995-01-01')) / 86400e6, 6) AS days, CAST(floor((epoch_us(o_orderdate::TIMESTAMP) + o_orderkey % 100 * 864000000 - epoch_us(TIMESTAMP '1995-01-01')) / 86400e6) AS BIGINT) AS whole, CAST(ceil((epoch_us(o_orderdate::TIMESTAMP) + o_orderkey % 100 * 864000000 - epoch_us(TIMESTAMP '1995-01-01')) / 86400e6) AS BIGINT) AS up FROM orders")
def _(t):
    ts = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 100 * 864000000)
    start = F.lit("1995-01-01 00:00:00").cast("timestamp")
    o = t.raw("orders").select("o_orderkey", ts.alias("ts"))
    return rounded(o.select("o_orderkey", X.days_since("ts", start).alias("days"), X.days_since("ts", start, "floor").cast("long").alias("whole"), X.days_since("ts", start, "ceil").cast("long").alias("up")))


@query("b12_day_edges", "SELECT event_id, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS lo, date_diff('day', TIMESTAMP '2024-01-01', CASE WHEN ts = date_trunc('day', ts) THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END) AS hi FROM events")
def _(t):
    day = lambda c: F.datediff(c, F.lit("2024-01-01").cast("date")).cast("long")
    return t.ev.select("event_id", day(X.day_floor("ts")).alias("lo"), day(X.day_ceil("ts")).alias("hi"))


_WN = "n::DOUBLE"


@query("b13_wilson_interval", with_("ev", f"SELECT traj_id, n, {R(f'greatest(0, (p + {Z}*{Z}/(2*n))/(1+{Z}*{Z}/n) - {Z}*sqrt(p*(1-p)/n+{Z}*{Z}/(4*n*n))/(1+{Z}*{Z}/n))', 'lo')}, {R(f'least(1, (p + {Z}*{Z}/(2*n))/(1+{Z}*{Z}/n) + {Z}*sqrt(p*(1-p)/n+{Z}*{Z}/(4*n*n))/(1+{Z}*{Z}/n))', 'hi')} FROM (SELECT traj_id, count(*)::DOUBLE AS n, avg(CASE WHEN event_type = 'signup' THEN 1e0 ELSE 0e0 END) AS p FROM ev GROUP BY traj_id)"))
def _(t):
    g = t.ev.groupBy("traj_id").agg(F.count("*").cast("double").alias("n"), F.avg((F.col("event_type") == "signup").cast("double")).alias("p"))
    lo, hi = X.wilson_interval("p", "n", Z)
    return rounded(g.select("traj_id", "n", lo.alias("lo"), hi.alias("hi")))


@query("b14_interp_linear", with_("draws", "SELECT traj_id, round(CASE WHEN x >= 4 THEN 16e0 ELSE floor(x)*floor(x) + (x-floor(x))*(2*floor(x)+1) END, 6) AS v FROM (SELECT traj_id, R0/2.5e0 AS x FROM draws)"))
def _(t):
    arr = F.array(*[F.lit(float(i * i)) for i in range(5)])
    return rounded(t.draws.select("traj_id", X.interp_array(arr, F.col("R0") / 2.5, 1.0).alias("v")))


@query("b15_scalar_weights", with_("draws", f"SELECT traj_id, {R('exp(-0.5*pow((R0-k)/2,2))', 'w')}, {R('(R0+k)/2 - (k-R0)/2*1.2', 'lo')}, {R('(R0+k)/2 + (k-R0)/2*1.2', 'hi')} FROM draws"))
def _(t):
    lo, hi = X.expand_interval("R0", "k", 1.2)
    return rounded(t.draws.select("traj_id", X.gaussian_distance_weight(F.col("R0") - F.col("k"), 2.0).alias("w"), lo.alias("lo"), hi.alias("hi")))


@query("b17_web_mercator", with_("herds", "SELECT herd_id, round(6378137*radians(lon), 3) AS x, round(6378137*ln(tan(pi()/4+radians(lat)/2)), 3) AS y FROM herds"))
def _(t):
    x, y = X.web_mercator("lon", "lat")
    return rounded(t.herds.select("herd_id", x.alias("x"), y.alias("y")), 3)


@query("b19_surface_norm", with_("draws", f"SELECT traj_id, {R('R0/max(R0) OVER ()', 'm')}, {R('1/(1+exp(-R0))', 's')}, {R('1-exp(-R0)', 'e')} FROM draws"))
def _(t):
    d = X.surface_norm(X.surface_norm(X.surface_norm(t.draws, "R0", "max", "m"), "R0", "sigmoid", "s"), "R0", "exp", "e")
    return rounded(d.select("traj_id", "m", "s", "e"))


@query("b21_option_maps", with_("draws", f"SELECT traj_id, {R('R0*2', 'a')}, {R('theta', 'b')}, {R('k', 'c')} FROM draws"))
def _(t):
    base = F.create_map(F.lit("a"), F.col("R0"), F.lit("b"), F.col("r"))
    over = F.create_map(F.lit("b"), F.col("theta"), F.lit("c"), F.col("k"))
    m = X.options_scale(X.options_merge(base, over), ["a"], 2.0)
    return rounded(t.draws.select("traj_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c")))


@query("b22_ultimate_extinction", "WITH RECURSIVE " + with_("draws", "SELECT traj_id, round(CASE WHEN R0 <= 1 THEN 1e0 ELSE q END, 6) AS q FROM it WHERE i = 200", ("it", "SELECT traj_id, R0, k, 0 AS i, 0e0 AS q FROM draws UNION ALL SELECT traj_id, R0, k, i + 1, pow((k/R0)/(k/R0+1-q), k) FROM it WHERE i < 200"))[5:])
def _(t):
    return rounded(quiet.ultimate(t.draws))


@query("b8_gamma_cdf_native", with_("draws", f"SELECT traj_id, {R(erlang('R0'), 'f')} FROM draws"))
def _(t):
    return rounded(t.draws.select("traj_id", S.gamma_cdf_native("R0", "alpha", "theta").alias("f")))


@query("b23_thinned_gamma_cdf", with_("draws", f"SELECT traj_id, {R(erlang('R0', 'alpha', '(theta/(1+0.1*theta))'), 'f')} FROM draws"))
def _(t):
    return rounded(t.draws.select("traj_id", S.thinned_gamma_cdf("exponential", 0.1)("R0", F.col("alpha").cast("double"), "theta").alias("f")))


@query("b23_thinned_weibull", with_("draws", f"SELECT traj_id, round(fx, 4) AS f FROM ({thinned_sql('R0', 0.1, 1.5, 3000, 'draws')})"))
def _(t):
    return rounded(t.draws.select("traj_id", S.thinned_gamma_cdf("weibull", 0.1, 1.5)("R0", F.col("alpha").cast("double"), "theta").alias("f")), 4)


_ISROOT = "(parent_id = first_value(parent_id) OVER (PARTITION BY traj_id ORDER BY parent_t, parent_id))"


@query("c2_index_offspring", with_("customers parents edges", "SELECT c.traj_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM customers c LEFT JOIN (SELECT e.traj_id, count(*) AS n FROM edges e JOIN roots r ON e.parent_id = r.parent_id GROUP BY e.traj_id) x ON c.traj_id = x.traj_id WHERE coalesce(n, 0) BETWEEN 0 AND 3", ("roots", "SELECT traj_id, parent_id FROM parents QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY t, parent_id) = 1")))
def _(t):
    roots = criteria.mark_roots(t.parents, "parent_id").filter("is_root").select("traj_id", "parent_id", "is_root")
    return criteria.index_offspring(t.customers, t.edges.join(roots, ["traj_id", "parent_id"]), 0, 3)


_CRIT = [IntervalCriterion(0, 5, 1, 30), IntervalCriterion(5, 20, 10, 60)]


@query("c3_interval_counts", with_("entities ev", "SELECT e.traj_id, CAST(coalesce(n0, 0) AS BIGINT) AS n0, CAST(coalesce(n1, 0) AS BIGINT) AS n1, coalesce(n0, 0) BETWEEN 1 AND 30 AND coalesce(n1, 0) BETWEEN 10 AND 60 AS ok FROM entities e LEFT JOIN (SELECT traj_id, count(*) FILTER (NOT is_root AND t BETWEEN 0 AND 5) AS n0, count(*) FILTER (NOT is_root AND t BETWEEN 5 AND 20) AS n1 FROM rooted GROUP BY traj_id) x ON e.traj_id = x.traj_id", ROOTED))
def _(t):
    return criteria.criteria_counts(t.entities, criteria.mark_roots(t.ev), _CRIT)


_WIN = "SELECT CAST(i AS INTEGER) AS win_id, i * 3e0 AS t_min, i * 3e0 + 2 AS t_max, CAST(0 AS BIGINT) AS lo, CAST(CASE WHEN i = 4 THEN 4 ELSE 9 END AS BIGINT) AS hi FROM range(8) r(i)"


def _windows(t):
    return t.spark.sql("SELECT cast(id AS int) AS win_id, id * 3e0 AS t_min, id * 3e0 + 2 AS t_max, 0L AS lo, CASE WHEN id = 4 THEN 4L ELSE 9L END AS hi FROM range(8)")


@query("c4_criterion_group", with_("entities ev", "SELECT traj_id FROM (SELECT e.traj_id, w.win_id, w.lo, w.hi, count(r.t) FILTER (NOT r.is_root) AS n FROM entities e CROSS JOIN win w LEFT JOIN rooted r ON r.traj_id = e.traj_id AND r.t BETWEEN w.t_min AND w.t_max GROUP BY ALL) GROUP BY traj_id HAVING bool_and(n BETWEEN lo AND hi)", ROOTED, ("win", _WIN)))
def _(t):
    return criteria.criterion_group(t.entities, criteria.mark_roots(t.ev), _windows(t))


@query("c5_outcome_label", with_("entities ev", "SELECT e.traj_id, CAST(coalesce(cases, 0) AS BIGINT) AS cases, CASE WHEN NOT coalesce(ok, false) THEN 'REJECTED' WHEN cases >= 70 THEN 'CAPPED_AT_MAX_CASES' WHEN last > 29 THEN 'CAPPED_AT_T_RUN' ELSE 'ACCEPTED' END AS outcome FROM entities e LEFT JOIN (SELECT traj_id, count(*) AS cases, max(t) AS last, count(*) FILTER (NOT is_root AND t BETWEEN 0 AND 5) BETWEEN 1 AND 30 AND count(*) FILTER (NOT is_root AND t BETWEEN 5 AND 20) BETWEEN 10 AND 60 AS ok FROM rooted GROUP BY traj_id) x ON e.traj_id = x.traj_id", ROOTED))
def _(t):
    ev = criteria.mark_roots(t.ev)
    return criteria.outcome_label(t.entities, ev, criteria.criteria_counts(t.entities, ev, _CRIT).filter("ok"), 29.0, 70)


@query("c6_quiet_for", with_("entities ev", f"SELECT traj_id FROM entities WHERE traj_id NOT IN (SELECT traj_id FROM ev WHERE event_type = 'signup' AND t > {T_STAR} AND t <= {T_STAR} + 3)"))
def _(t):
    return criteria.quiet_for(t.entities, t.ev.filter("event_type = 'signup'"), T_STAR, 3.0)


@query("c7_min_required", with_("draws", "SELECT traj_id FROM draws WHERE R0 * r < 3 ORDER BY traj_id LIMIT 100"))
def _(t):
    return ingest.min_required(X.prior_validator(t.draws, ["R0 * r < 3"]).select("traj_id"), 100)


@query("c8_observation_prefix", with_("observations", "SELECT series_id, d, CAST(n AS BIGINT) AS n, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM observations QUALIFY rn <= 3"))
def _(t):
    return criteria.observation_prefix(t.observations, 3).select("series_id", "d", "n", F.col("rn").cast("long").alias("rn"))


@query("c10_finite_only", "SELECT c_custkey, round(ln(c_acctbal), 6) AS v FROM customer WHERE c_acctbal > 0")
def _(t):
    d = t.raw("customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.log("c_acctbal")).when(F.col("c_acctbal") == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))).alias("v"))
    return rounded(X.finite_only(d, "v"))


@query("d1_join_dims", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    n = t.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    r = t.raw("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return spatial.join_dims(t.raw("supplier").select("s_suppkey", "s_nationkey"), [(n, "s_nationkey"), (r, "n_regionkey")]).select("s_suppkey", "n_name", "r_name")


@query("d2_observed_cumulative_at", "WITH o AS (SELECT o_custkey AS series_id, o_orderdate::TIMESTAMP AS ts, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT DISTINCT o_custkey AS series_id, date_trunc('year', o_orderdate::TIMESTAMP) + INTERVAL 1 YEAR AS ts FROM orders) SELECT p.series_id, epoch_us(p.ts) AS at, CAST(sum(n) AS BIGINT) AS cum FROM p JOIN o ON o.series_id = p.series_id AND o.ts <= p.ts GROUP BY ALL")
def _(t):
    o = t.raw("orders").groupBy(F.col("o_custkey").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("ts")).agg(F.count("*").alias("n"))
    p = t.raw("orders").select(F.col("o_custkey").alias("series_id"), (F.date_trunc("year", F.col("o_orderdate").cast("timestamp")) + F.expr("INTERVAL 1 YEAR")).alias("ts")).distinct()
    return criteria.observed_cumulative_at(o, p).select("series_id", F.unix_micros("ts").alias("at"), "cum")


@query("d3_apply_scenario", with_("ev draws", "SELECT e.event_id, round(CASE WHEN t < 5 THEN R0 WHEN t < 12 THEN R0 * r WHEN t < 20 THEN R0 * r / 2 ELSE R0 END, 6) AS R0 FROM ev e JOIN draws d ON e.traj_id = d.traj_id"))
def _(t):
    pieces = criteria.apply_scenario(t.draws, [(5.0, "R0", "R0 * r"), (12.0, "R0", "R0 / 2"), (20.0, "R0", None)])
    return rounded(criteria.params_at(t.ev.select("traj_id", "event_id", "t"), pieces).select("event_id", "R0"))


@query("d4_window_counts", with_("ev", "SELECT traj_id, win_id, count(*) AS n FROM ev JOIN win ON t BETWEEN t_min AND t_max GROUP BY ALL", ("win", _WIN)))
def _(t):
    return criteria.window_counts(t.ev, _windows(t))


@query("d5_cluster_of", with_("ev", "SELECT event_id AS id, coalesce(min(win_id), -1) AS cluster FROM ev LEFT JOIN win ON t BETWEEN t_min AND t_max GROUP BY event_id", ("win", _WIN)))
def _(t):
    return criteria.cluster_of(t.ev.select(F.col("event_id").alias("id"), "t"), _windows(t)).select("id", "cluster")


@query("d6_pre_children", with_("parents edges", f"SELECT p.traj_id, p.parent_id, CAST(coalesce(n, 0) AS BIGINT) AS n_pre FROM parents p LEFT JOIN (SELECT parent_id, count(*) AS n FROM edges WHERE parent_t <= {EDGE_STAR} AND child_t <= {EDGE_STAR} AND child_t > parent_t GROUP BY parent_id) x ON p.parent_id = x.parent_id"))
def _(t):
    return quiet.pre_children(t.parents, t.edges, EDGE_STAR).select("traj_id", "parent_id", "n_pre")


@query("d7_align_prefix", with_("draws edges", "SELECT traj_id, count(*) AS n FROM edges WHERE traj_id IN (SELECT traj_id FROM draws WHERE R0 * r < 3) GROUP BY traj_id"))
def _(t):
    _, e = ingest.align_prefix(X.prior_validator(t.draws, ["R0 * r < 3"]), t.edges)
    return e.groupBy("traj_id").agg(F.count("*").alias("n"))


def _unit(*parts: str) -> str:
    """The hash draw of these parts."""
    return f"CAST(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 10))::BIGINT AS DOUBLE) / 1099511627776e0"


_DONORS = (
    ("kids", "SELECT traj_id, child_id, child_t AS t FROM edges WHERE child_t > 0 AND child_t > 1e-9"),
    ("pool", f"SELECT traj_id AS donor, row_number() OVER (ORDER BY {_unit("'7'", 'traj_id')}, traj_id) - 1 AS idx, count(*) OVER () AS size FROM (SELECT DISTINCT traj_id FROM ev)"),
    ("pick", f"SELECT traj_id, t, CAST(floor({_unit("'7'", 'traj_id', 'child_id')} * (SELECT max(size) FROM pool)) AS BIGINT) AS idx FROM kids"),
    ("given", "SELECT k.traj_id, k.t + e.t AS t FROM pick k JOIN pool USING (idx) JOIN ev e ON e.traj_id = donor UNION ALL SELECT traj_id, t FROM kids UNION ALL SELECT DISTINCT traj_id, 0e0 FROM kids"),
)


@query("d8_attach_donors", with_("edges ev", "SELECT traj_id, count(*) AS n, round(max(t), 6) AS last FROM given GROUP BY traj_id", *_DONORS))
def _(t):
    kids = collect.first_generation(t.edges.select("traj_id", "child_id", (F.col("parent_t") * 0).alias("parent_t"), F.col("child_t")).filter("child_t > 0"))
    out = quiet.attach_donors(kids.select("traj_id", "child_id", F.col("child_t").alias("t")), t.ev.select("traj_id", "t"), 7)
    return rounded(out.groupBy("traj_id").agg(F.count("*").alias("n"), F.max("t").alias("last")))


@query("d9_representatives", with_("draws", "SELECT DISTINCT id AS traj_id FROM (SELECT arg_min(traj_id, row(pow(R0-qx,2)+pow(k-qy,2), traj_id)) AS id FROM draws, a, b GROUP BY qx, qy)", ("a", "SELECT unnest(quantile_cont(R0, [0.1, 0.5, 0.9])) AS qx FROM draws"), ("b", "SELECT unnest(quantile_cont(k, [0.1, 0.5, 0.9])) AS qy FROM draws")))
def _(t):
    return quiet.representatives(t.draws, "R0", "k")


@query("d10_active_at", with_("customers edges", f"SELECT c.traj_id, count(x.traj_id) AS n, count(x.traj_id) = 0 AS finished FROM customers c LEFT JOIN (SELECT traj_id FROM edges WHERE parent_t <= {EDGE_STAR} AND child_t > {EDGE_STAR}) x ON c.traj_id = x.traj_id GROUP BY c.traj_id"))
def _(t):
    n = collect.active_set_size(t.customers, t.edges, EDGE_STAR)
    done = quiet.finished_at(t.customers, t.edges, EDGE_STAR).withColumn("finished", F.lit(True))
    return n.join(done, "traj_id", "left").select("traj_id", "n", F.coalesce("finished", F.lit(False)).alias("finished"))


_POLY = "VALUES (17e0,46e0,22e0,46e0),(22e0,46e0,22e0,48e0),(22e0,48e0,19.5e0,47e0),(19.5e0,47e0,17e0,48.4e0),(17e0,48.4e0,17e0,46e0)"


@query("d11_points_in_polygon", with_("herds", "SELECT herd_id AS id, (SELECT count(*) FROM poly WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1) % 2 = 1 AS inside FROM herds", ("poly", f"SELECT * FROM ({_POLY}) v(x1,y1,x2,y2)")))
def _(t):
    edges = t.spark.sql(f"SELECT * FROM {_POLY} AS v(x1,y1,x2,y2)")
    return spatial.points_in_polygon(t.herds.select(F.col("herd_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y")), edges).select("id", "inside")


#: A lozenge around each place, of a size of its own: as many edges as rows allow.
_LOZENGES = "SELECT lon - w AS x1, lat AS y1, lon AS x2, lat + w AS y2 FROM sized UNION ALL SELECT lon, lat + w, lon + w, lat FROM sized UNION ALL SELECT lon + w, lat, lon, lat - w FROM sized UNION ALL SELECT lon, lat - w, lon - w, lat FROM sized"


@query("d11_points_in_many_polygons", with_("herds", "SELECT herd_id AS id, (SELECT count(*) FROM lozenges WHERE (y1 > lat + 0.0123e0) <> (y2 > lat + 0.0123e0) AND lon + 0.0071e0 < (x2-x1)*(lat+0.0123e0-y1)/(y2-y1)+x1) % 2 = 1 AS inside FROM herds", ("sized", "SELECT lon, lat, 0.05e0 + herd_size / 400e0 AS w FROM herds"), ("lozenges", _LOZENGES)))
def _(t):
    sized = t.herds.select("lon", "lat", (0.05 + F.col("herd_size") / 400).alias("w"))
    edges = t.spark.sql(_LOZENGES.replace("sized", "{sized}"), sized=sized)
    points = t.herds.select(F.col("herd_id").alias("id"), (F.col("lon") + 0.0071).alias("x"), (F.col("lat") + 0.0123).alias("y"))
    return spatial.points_in_polygon(points, edges).select("id", "inside")


@query("d13_by_distinct_key", with_("draws", "SELECT traj_id, round(pow(round(theta, 6), 2), 6) AS sq FROM draws"))
def _(t):
    return rounded(quiet.by_distinct_key(t.draws, ["theta"], lambda k: k.withColumn("sq", F.pow("theta", F.lit(2)))).select("traj_id", "sq"))


@query("e1_hist1d", with_("draws", "SELECT CAST(least(floor((R0*r)/6e0*20), 19) AS BIGINT) AS bin, count(*) AS n FROM draws WHERE R0*r BETWEEN 0 AND 6 GROUP BY 1"))
def _(t):
    return collect.hist1d(t.draws, "R0 * r", 20, 0.0, 6.0)


@query("e2_hist2d", with_("draws", "SELECT CAST(least(floor((R0-0.25e0)/14.75e0*10), 9) AS BIGINT) AS bx, CAST(least(floor((k-0.2e0)/9.8e0*10), 9) AS BIGINT) AS by, count(*) AS n FROM draws WHERE R0 BETWEEN 0.25e0 AND 15 AND k BETWEEN 0.2e0 AND 10 GROUP BY 1, 2"))
def _(t):
    return collect.hist2d(t.draws, "R0", "k", 10, (0.25, 15.0), (0.2, 10.0))


@query("e3_hist_density", with_("draws", "SELECT b.bin, round((b.bin+0.5e0)*0.3e0, 6) AS centre, round(coalesce(n,0)/(sum(n) OVER ()*0.3e0), 6) AS density FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN (SELECT CAST(least(floor((R0*r)/6e0*20), 19) AS BIGINT) AS bin, count(*) AS n FROM draws WHERE R0*r BETWEEN 0 AND 6 GROUP BY 1) h ON b.bin = h.bin"))
def _(t):
    return rounded(collect.hist_density(collect.hist1d(t.draws, "R0 * r", 20, 0.0, 6.0), 20, 0.0, 6.0))


_STATE = ("state", "SELECT traj_id, max(day) AS last_day, coalesce(min(day) FILTER (day > 20 AND day <= 28), 29) AS first_after FROM (SELECT traj_id, CAST(greatest(0, least(floor(t), 29)) AS BIGINT) AS day FROM ev) GROUP BY traj_id")


@query("e4_time_matrix", with_("ev", "SELECT last_day, first_after, count(*) AS n FROM state GROUP BY ALL", _STATE))
def _(t):
    return collect.time_matrix(t.ev, 28, 20)


@query("e8_first_generation", with_("edges", "SELECT traj_id, count(*) AS n FROM edges WHERE parent_t < 1e-9 AND child_t > 1e-9 GROUP BY traj_id"))
def _(t):
    return collect.first_generation(t.edges).groupBy("traj_id").agg(F.count("*").alias("n"))


@query("e9_acceptance_counts", with_("draws", "SELECT CAST(floor(traj_id / 100) AS BIGINT) AS chunk, count(*) FILTER (R0 * r < 3) AS accepted, count(*) AS processed FROM draws GROUP BY 1"))
def _(t):
    return collect.acceptance_counts(t.draws.withColumn("ok", F.expr("R0 * r < 3")), "ok", F.floor(F.col("traj_id") / 100).cast("long"))


@query("e10_hist2d_weighted", with_("herds", "SELECT CAST(least(floor((lon-16)/7e0*8), 7) AS BIGINT) AS ix, CAST(least(floor((lat-45.5e0)/3.2e0*8), 7) AS BIGINT) AS iy, round(sum(herd_size::DOUBLE), 6) AS w FROM herds WHERE lon BETWEEN 16 AND 23 AND lat BETWEEN 45.5e0 AND 48.7e0 GROUP BY 1, 2"))
def _(t):
    pts = t.herds.select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("herd_size").cast("double").alias("w"))
    return rounded(spatial.weighted_cells(pts, (16.0, 45.5, 23.0, 48.7), 8))


_CUM = ("cum", "SELECT e.traj_id, g.i, g.g, count(v.t) AS y FROM entities e CROSS JOIN (SELECT i, i * 1e0 AS g FROM range(31) r(i)) g LEFT JOIN sg v ON v.traj_id = e.traj_id AND v.t <= g.g GROUP BY ALL")
_SG = ("sg", "SELECT * FROM ev WHERE event_type = 'signup'")
SIGNUP = "event_type = 'signup'"


@query("f1_cumulative_matrix", with_("entities ev", "SELECT traj_id, i, g, y FROM cum", _SG, _CUM))
def _(t):
    return curves.cumulative_matrix(t.entities, t.ev.filter(SIGNUP), 0.0, 1.0, 31)


@query("f2_mean_cumulative", with_("entities ev", "SELECT g, round(avg(y), 6) AS mean FROM cum GROUP BY g", _SG, _CUM))
def _(t):
    return rounded(curves.mean_cumulative(t.entities, t.ev.filter(SIGNUP), t.grid(0, 30, 1, "g")))


@query("f3_median_cumulative", with_("entities ev", "SELECT g, round(quantile_cont(y, 0.5), 6) AS median FROM cum GROUP BY g", _SG, _CUM))
def _(t):
    return rounded(curves.median_cumulative(curves.cumulative_matrix(t.entities, t.ev.filter(SIGNUP), 0.0, 1.0, 31)))


@query("f4_l2_distance", with_("entities ev", "SELECT round(avg(pow(a-b, 2)) + 900, 6) AS l2 FROM (SELECT g, avg(y) AS a, quantile_cont(y, 0.5) AS b FROM cum GROUP BY g)", _SG, _CUM))
def _(t):
    m = curves.cumulative_matrix(t.entities, t.ev.filter(SIGNUP), 0.0, 1.0, 31)
    mean = curves.mean_cumulative(t.entities, t.ev.filter(SIGNUP), t.grid(0, 30, 1, "g")).withColumnRenamed("mean", "a")
    return rounded(curves.l2_distance(mean, curves.median_cumulative(m).withColumnRenamed("median", "b"), "g", accepted=50))


_S = 0.8**0.7


@query("f5_tail_mean_band", with_("entities ev", f"SELECT g, round(mean, 6) AS mean, round(mean+(lo-mean)*{_S}, 6) AS lo, round(mean+(hi-mean)*{_S}, 6) AS hi FROM (SELECT g, avg(y) AS mean, avg(y) FILTER (rn <= m) AS lo, avg(y) FILTER (rn > N - m) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y) AS rn, count(*) OVER (PARTITION BY g) AS N, greatest(1, ceil(count(*) OVER (PARTITION BY g) * {(1 - 0.8) / 2!r}::DOUBLE)) AS m FROM cum) GROUP BY g)", _SG, _CUM))
def _(t):
    return rounded(curves.tail_mean_band(curves.cumulative_matrix(t.entities, t.ev.filter(SIGNUP), 0.0, 1.0, 31), 0.8))


@query("f6_cond_cumulative", with_("entities ev", f"SELECT s.T AS T, g, round(count(v.t) / max(N)::DOUBLE, 6) AS mean, max(N) AS n FROM (SELECT s.*, count(*) OVER (PARTITION BY s.T) AS N FROM surv s) s CROSS JOIN (SELECT i * 1e0 AS g FROM range(11) r(i)) gg LEFT JOIN sg v ON v.traj_id = s.traj_id AND v.t > {T_STAR} AND v.t - {T_STAR} <= g GROUP BY s.T, g", _SG, ("surv", f"SELECT f.traj_id, T FROM (SELECT e.traj_id, min(t) - {T_STAR} AS fp FROM entities e LEFT JOIN sg v ON e.traj_id = v.traj_id AND t > {T_STAR} GROUP BY e.traj_id) f, (SELECT unnest([0e0, 1e0, 3e0]) AS T) WHERE fp IS NULL OR fp > T")))
def _(t):
    first = criteria.first_post(t.entities, t.ev.filter(SIGNUP), T_STAR)
    Ts = t.spark.sql("SELECT explode(array(0e0, 1e0, 3e0)) AS T")
    return rounded(curves.cond_cumulative(first, t.ev.filter(SIGNUP), T_STAR, Ts, 0.0, 1.0, 11).select("T", "g", "mean", "n"))


@query("f13_first_crossing", with_("entities ev", "SELECT traj_id, round(min(x), 6) AS crossing FROM (SELECT traj_id, CASE WHEN py IS NULL OR py >= 2.5 OR y = py THEN g ELSE pg + (2.5 - py) * (g - pg) / (y - py) END AS x FROM (SELECT traj_id, g, y, lag(g) OVER w AS pg, lag(y) OVER w AS py FROM cum WINDOW w AS (PARTITION BY traj_id ORDER BY g)) WHERE y >= 2.5) GROUP BY traj_id", _SG, _CUM))
def _(t):
    m = curves.cumulative_matrix(t.entities, t.ev.filter(SIGNUP), 0.0, 1.0, 31)
    return rounded(curves.first_crossing(m, 2.5, ["traj_id"], "g", "y"))


_FP = ("fp", f"SELECT e.traj_id, min(t) FILTER (t > {T_STAR}) - {T_STAR} AS first_post, max(t) AS last_t FROM entities e LEFT JOIN sg v ON e.traj_id = v.traj_id GROUP BY e.traj_id")


@query("f14_acceptance_ratio_path", with_("entities ev", "SELECT T, round(count(*) FILTER (first_post IS NULL OR first_post > T) / 200e0, 6) AS ratio FROM fp, g GROUP BY T", _SG, _FP, ("g", grid_sql(0, 10, 1))))
def _(t):
    return rounded(curves.acceptance_ratio_path(criteria.first_post(t.entities, t.ev.filter(SIGNUP), T_STAR), t.grid(0, 10, 1), F.lit(200.0)))


@query("f17_horizon_days", with_("observations", "SELECT series_id, CAST(ceil(greatest(max(d)-min(d), max(d)*0+250) + ceil(coalesce(max(gap), 0)) + 1) AS BIGINT) AS horizon FROM (SELECT series_id, d, lead(d) OVER (PARTITION BY series_id ORDER BY d) - d AS gap FROM observations) GROUP BY series_id"))
def _(t):
    w = t.observations.select("series_id", F.lit(250.0).alias("t_max")).distinct()
    return curves.horizon_days(t.observations, w)


@query("f18_timepath", with_("entities ev draws", "SELECT T, metric, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS q050, round(quantile_cont(value, 0.5), 6) AS q500, round(quantile_cont(value, 0.95), 6) AS q950 FROM (SELECT T, 'R0' AS metric, R0 AS value FROM rows UNION ALL SELECT T, 'k', k FROM rows) GROUP BY T, metric", _SG, _FP, ("rows", "SELECT T, R0, k FROM fp JOIN draws USING (traj_id), (SELECT unnest([0e0, 1e0, 2e0, 4e0]) AS T) WHERE first_post IS NULL OR first_post > T")))
def _(t):
    first = criteria.first_post(t.entities, t.ev.filter(SIGNUP), T_STAR).join(t.draws, "traj_id")
    return rounded(curves.timepath(first, ["R0", "k"], t.spark.sql("SELECT explode(array(0e0, 1e0, 2e0, 4e0)) AS T")))


_BAND = 0.9**0.7


@query(
    "f19_timepath_weighted",
    with_(
        "entities ev draws",
        f"SELECT T, max(n) AS n, round(max(m), 6) AS mean, round(max(m) + (sum(R0*w) FILTER (low) / sum(w) FILTER (low) - max(m)) * {_BAND}, 6) AS lo, round(max(m) + (sum(R0*w) FILTER (high) / sum(w) FILTER (high) - max(m)) * {_BAND}, 6) AS hi FROM (SELECT *, cum <= total*0.05 OR R0 = min(R0) OVER k AS low, cum >= total - total*0.05 OR R0 = max(R0) OVER k AS high, sum(R0*w) OVER k / total AS m FROM cw WINDOW k AS (PARTITION BY T)) GROUP BY T",
        _SG, _FP,
        ("alive", "SELECT T, R0, first_post, CASE WHEN first_post IS NULL THEN 0e0 ELSE exp(-0.5*pow((first_post-T)/2,2)) END AS w FROM fp JOIN draws USING (traj_id), (SELECT unnest([0e0, 1e0, 2e0, 4e0]) AS T) WHERE first_post IS NULL OR first_post > T"),
        ("own", "SELECT T, R0, count(*) OVER k AS n, CASE WHEN max(first_post) OVER k IS NULL THEN 1e0 WHEN first_post IS NULL THEN 0e0 WHEN sum(w) OVER k > 0 THEN w ELSE 1e0 END AS w FROM alive WINDOW k AS (PARTITION BY T)"),
        ("runs", "SELECT T, R0, max(n) AS n, sum(w) AS w FROM own WHERE w > 0 GROUP BY T, R0"),
        ("cw", "SELECT *, sum(w) OVER (PARTITION BY T ORDER BY R0) AS cum, sum(w) OVER (PARTITION BY T) AS total FROM runs"),
    ),
)
def _(t):
    first = criteria.first_post(t.entities, t.ev.filter(SIGNUP), T_STAR).join(t.draws, "traj_id")
    return rounded(curves.timepath_weighted(first, "R0", t.spark.sql("SELECT explode(array(0e0, 1e0, 2e0, 4e0)) AS T"), 2.0))


#: Four snapshots at uneven distances; the last ends 6.5 days later.
_SNAPS = ("snaps", "SELECT *, coalesce(lead(t_star) OVER (ORDER BY t_star) - t_star, 6.5e0) AS next_t FROM (SELECT CAST(i AS BIGINT) AS snap_id, 10e0 + 4.5e0 * i + 0.25e0 * i * i AS t_star FROM range(4) r(i))")
_SEG = ("seg", "SELECT snap_id, t_star, CASE WHEN n > 1 THEN next_t * j / (n - 1) ELSE 0e0 END AS T FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS j FROM (SELECT *, greatest(1, floor(next_t / 1.5) + 1) AS n FROM snaps))")
_SFP = ("sfp", "SELECT s.snap_id, e.traj_id, min(v.t) FILTER (v.t > s.t_star) - s.t_star AS first_post FROM snaps s CROSS JOIN entities e LEFT JOIN sg v ON e.traj_id = v.traj_id GROUP BY s.snap_id, s.t_star, e.traj_id")


def _snapshots(t):
    """First events of all draws after each snapshot, and the snapshots' quiet times."""
    snaps = t.spark.sql("SELECT 1 AS series_id, id AS snap_id, 10e0 + 4.5e0 * id + 0.25e0 * id * id AS t_star FROM range(4)")
    snaps = curves.next_gap(snaps, 6.5)
    first = curves.snapshot_first_post(t.entities, t.ev.filter(SIGNUP), snaps).join(t.draws, "traj_id")
    return first, curves.segment_grid(snaps, 1.5)


@query("f18_timepath_snapshots", with_("entities ev draws", "SELECT snap_id, round(t_star + T, 4) AS x, metric, count(*) AS n, round(quantile_cont(value, 0.05), 4) AS q050, round(quantile_cont(value, 0.5), 4) AS q500, round(quantile_cont(value, 0.95), 4) AS q950 FROM (SELECT snap_id, t_star, T, 'log_R0' AS metric, ln(R0) AS value FROM rows UNION ALL SELECT snap_id, t_star, T, 'log_k', ln(k) FROM rows) GROUP BY snap_id, t_star, T, metric", _SG, _SNAPS, _SEG, _SFP, ("rows", "SELECT snap_id, t_star, T, R0, k FROM sfp JOIN draws USING (traj_id) JOIN seg USING (snap_id) WHERE first_post IS NULL OR first_post > T")))
def _(t):
    first, grid = _snapshots(t)
    first = first.withColumn("log_R0", F.log("R0")).withColumn("log_k", F.log("k"))
    out = curves.timepath(first, ["log_R0", "log_k"], grid, keys=("snap_id",))
    return rounded(out.join(F.broadcast(grid), ["snap_id", "T"]).select("snap_id", F.round("x", 4).alias("x"), "metric", "n", "q050", "q500", "q950"), 4)


@query(
    "f19_timepath_snapshots",
    with_(
        "entities ev draws",
        f"SELECT snap_id, round(t_star + T, 6) AS x, max(n) AS n, round(max(m), 6) AS mean, round(max(m) + (sum(R0*w) FILTER (low) / sum(w) FILTER (low) - max(m)) * {_BAND}, 6) AS lo, round(max(m) + (sum(R0*w) FILTER (high) / sum(w) FILTER (high) - max(m)) * {_BAND}, 6) AS hi FROM (SELECT *, cum <= total*0.05 OR R0 = min(R0) OVER k AS low, cum >= total - total*0.05 OR R0 = max(R0) OVER k AS high, sum(R0*w) OVER k / total AS m FROM cw WINDOW k AS (PARTITION BY snap_id, T)) GROUP BY snap_id, t_star, T",
        _SG, _SNAPS, _SEG, _SFP,
        ("alive", "SELECT snap_id, t_star, T, R0, first_post, CASE WHEN first_post IS NULL THEN 0e0 ELSE exp(-0.5*pow((first_post-T)/2,2)) END AS w FROM sfp JOIN draws USING (traj_id) JOIN seg USING (snap_id) WHERE first_post IS NULL OR first_post > T"),
        ("own", "SELECT snap_id, t_star, T, R0, count(*) OVER k AS n, CASE WHEN max(first_post) OVER k IS NULL THEN 1e0 WHEN first_post IS NULL THEN 0e0 WHEN sum(w) OVER k > 0 THEN w ELSE 1e0 END AS w FROM alive WINDOW k AS (PARTITION BY snap_id, T)"),
        ("runs", "SELECT snap_id, t_star, T, R0, max(n) AS n, sum(w) AS w FROM own WHERE w > 0 GROUP BY snap_id, t_star, T, R0"),
        ("cw", "SELECT *, sum(w) OVER (PARTITION BY snap_id, T ORDER BY R0) AS cum, sum(w) OVER (PARTITION BY snap_id, T) AS total FROM runs"),
    ),
)
def _(t):
    first, grid = _snapshots(t)
    out = curves.timepath_weighted(first, "R0", grid, 2.0, keys=("snap_id",))
    return rounded(out.join(F.broadcast(grid), ["snap_id", "T"]).select("snap_id", "x", "n", "mean", "lo", "hi"))


@query("h1_first_post", with_("entities ev", f"SELECT traj_id, {R('first_post')}, {R('last_t')} FROM fp", _SG, _FP))
def _(t):
    return rounded(criteria.first_post(t.entities, t.ev.filter(SIGNUP), T_STAR))


@query("h5_running_total", with_("observations", "SELECT series_id, round(d, 6) AS d, CAST(sum(n) OVER (PARTITION BY series_id ORDER BY ts) AS BIGINT) AS total FROM observations"))
def _(t):
    return rounded(curves.running_total(t.observations).select("series_id", "d", "total"))


@query("h7_next_gap", with_("observations", "SELECT series_id, snap_id, round(coalesce(lead(d) OVER w - d, 30), 6) AS next_t, round(d - first_value(d) OVER w, 6) AS \"offset\", round(d + coalesce(lead(d) OVER w - d, 30), 6) AS segment_end FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d) AS snap_id FROM observations) WINDOW w AS (PARTITION BY series_id ORDER BY d, snap_id)"))
def _(t):
    s = t.observations.select("series_id", F.col("d").alias("t_star"), F.row_number().over(Window.partitionBy("series_id").orderBy("d")).cast("long").alias("snap_id"))
    return rounded(curves.next_gap(s, 30.0).select("series_id", "snap_id", "next_t", "offset", "segment_end"))


_SNAPS = ("snaps", "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY d) AS snap_id, d AS t_star FROM observations")


def _snaps(t):
    return t.observations.select("series_id", F.col("d").alias("t_star"), F.row_number().over(Window.partitionBy("series_id").orderBy("d")).cast("long").alias("snap_id"))


@query("c9_since_axis_start", with_("observations", "SELECT series_id, snap_id, round(t_star, 6) AS t_star FROM snaps WHERE t_star >= 120", _SNAPS))
def _(t):
    return rounded(criteria.since_axis_start(_snaps(t), 120.0).select("series_id", "snap_id", "t_star"))


@query("i1_chronological", with_("observations", "SELECT series_id, snap_id, round(t_star, 6) AS t_star, row_number() OVER (PARTITION BY series_id ORDER BY t_star, snap_id) AS place FROM snaps", _SNAPS))
def _(t):
    ordered = curves.chronological(_snaps(t)).withColumn("at", F.monotonically_increasing_id())
    return rounded(ordered.select("series_id", "snap_id", "t_star", F.row_number().over(Window.partitionBy("series_id").orderBy("at")).cast("long").alias("place")))


@query("j3_pool", with_("parents edges", "SELECT round(t, 6) AS t, count(*) AS n FROM (SELECT t FROM parents UNION ALL SELECT child_t FROM edges) GROUP BY 1"))
def _(t):
    return curves.pool(t.parents.select("t"), t.edges.select(F.col("child_t").alias("t"))).groupBy(F.round("t", 6).alias("t")).agg(F.count("*").alias("n"))


#: Each snapshot's curve at T = 0, 5, .. 30: exp(-T / (5 + snap_id)).
_ONLINE = (
    ("gaps", "SELECT series_id, snap_id, coalesce(lead(t_star) OVER w - t_star, 30e0) AS next_t, t_star - first_value(t_star) OVER w AS off FROM snaps WINDOW w AS (PARTITION BY series_id ORDER BY t_star, snap_id)"),
    ("pts", "SELECT series_id, snap_id, next_t, off, i * 5e0 AS T, exp(-i * 5e0 / (5 + snap_id)) AS p FROM gaps, range(7) r(i)"),
    ("ends", "SELECT a.series_id, a.snap_id, a.p + (b.p - a.p) * (a.next_t - a.T) / 5e0 AS p_end FROM pts a JOIN pts b ON a.series_id = b.series_id AND a.snap_id = b.snap_id AND b.T = a.T + 5 WHERE a.T < a.next_t AND b.T >= a.next_t"),
)


@query("f20_online_curve", with_("observations", 'SELECT p.series_id, p.snap_id, round(off + T, 6) AS x, round(p, 6) AS p, round(p_end, 6) AS p_end FROM pts p LEFT JOIN ends e ON p.series_id = e.series_id AND p.snap_id = e.snap_id WHERE T <= next_t', _SNAPS, *_ONLINE))
def _(t):
    s = curves.next_gap(_snaps(t), 30.0)
    c = s.select("series_id", "snap_id", F.explode(F.array(*[F.lit(5.0 * i) for i in range(7)])).alias("T")).withColumn("p", F.exp(-F.col("T") / (5 + F.col("snap_id"))))
    return rounded(curves.online_curve(c, s))


@query("h8_infer_pairs", with_("ev", f"SELECT traj_id, round(prev, 6) AS prev, round(t, 6) AS cur FROM (SELECT traj_id, t, lag(t) OVER (PARTITION BY traj_id ORDER BY t, event_id) AS prev FROM ev) WHERE prev <= {T_STAR} AND t > {T_STAR}"))
def _(t):
    return rounded(curves.infer_pairs(t.ev, T_STAR))


@query("h9_trapezoid_area", with_("observations", "SELECT series_id, round(coalesce(sum((d-pd)*(n+pn)/2), 0), 6) AS area FROM (SELECT series_id, d, n, lag(d) OVER w AS pd, lag(n) OVER w AS pn FROM observations WINDOW w AS (PARTITION BY series_id ORDER BY d)) GROUP BY series_id"))
def _(t):
    return rounded(curves.trapezoid_area(t.observations, ["series_id"], "d", "n"))


@query("i3_first_n", with_("customers edges", "SELECT traj_id, count(*) AS n FROM edges WHERE traj_id IN (SELECT traj_id FROM customers ORDER BY traj_id LIMIT 50) GROUP BY traj_id"))
def _(t):
    (e,) = ingest.first_n(t.customers, 50, t.edges)
    return e.groupBy("traj_id").agg(F.count("*").alias("n"))


@query("i5_choose", with_("customers", "SELECT traj_id FROM customers ORDER BY md5('3:' || traj_id), traj_id LIMIT 100"))
def _(t):
    return ingest.choose(t.customers, 100, 3)


@query("j4_distinct_times", with_("edges", f"SELECT traj_id, count(DISTINCT parent_t) AS n FROM edges WHERE parent_t <= {EDGE_STAR} GROUP BY traj_id"))
def _(t):
    return quiet.distinct_times(t.edges.filter(F.col("parent_t") <= EDGE_STAR)).groupBy("traj_id").agg(F.count("*").alias("n"))


@query("j5_multiplicity", with_("parents", "SELECT round(t, 6) AS t, count(*) AS n FROM parents GROUP BY 1"))
def _(t):
    return rounded(quiet.multiplicity(t.parents.select(F.round("t", 6).alias("t"))))


_ = (math, DUCK)
