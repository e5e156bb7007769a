"""Is it over? Probabilities that an event process has ended after a quiet time T from a cutoff t_star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import series
from ..functions.expr import ultimate_extinction
from ..functions.special import gamma_cdf, gamma_cdf_np, gamma_pdf, gamma_pdf_np, thinned_gamma_cdf
from ..session import ship
from ..sources.ingest import unit_hash
from .criteria import first_post
from .nested import reach, reaching
from .ranks import attach, percentiles


def grid_cross(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Each row at each grid point; the grid is small."""
    return df.crossJoin(F.broadcast(grid))


def by_distinct_key(df: DataFrame, keys: list[str], compute, digits: int = 6) -> DataFrame:
    """Computes once for each distinct rounded key and joins the result back."""
    rounded = df
    for k in keys:
        rounded = rounded.withColumn(f"__{k}", F.round(F.col(k), digits))
    unique = rounded.select(*[F.col(f"__{k}").alias(k) for k in keys]).distinct()
    done = compute(unique).withColumnsRenamed({k: f"__{k}" for k in keys})
    return rounded.join(done, [f"__{k}" for k in keys]).drop(*[f"__{k}" for k in keys])


def active_at(edges: DataFrame, t_star: float) -> DataFrame:
    return edges.filter((F.col("parent_t") <= t_star) & (F.col("child_t") > t_star))


def finished_at(entities: DataFrame, edges: DataFrame, t_star: float) -> DataFrame:
    return entities.join(active_at(edges, t_star), "traj_id", "left_anti")


def pre_children(parents: DataFrame, edges: DataFrame, t_star: float) -> DataFrame:
    """Adds n_pre, children after the parent and up to the cutoff; parents are matched by id."""
    n = edges.filter((F.col("parent_t") <= t_star) & (F.col("child_t") <= t_star) & (F.col("child_t") > F.col("parent_t"))).groupBy("traj_id", "parent_id").agg(F.count("*").alias("n_pre"))
    return parents.join(n, ["traj_id", "parent_id"], "left").withColumn("n_pre", F.coalesce("n_pre", F.lit(0)).cast("long"))


def attach_donors(children: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """Each child (traj_id, child_id, t) takes the events of one pool trajectory, shifted by its time; children and a root at 0 are
    events too. Donors are drawn with replacement: the pool's trajectories are numbered in the order of their hash, and a child takes the
    number that its own hash falls on. Numbers come from sizes of 1024 parts of the hash, so that nothing is sorted in one task."""
    n = pool.select("traj_id").distinct().count()
    if not n:
        return children.select("traj_id", "t")
    ids = pool.select("traj_id").distinct().withColumn("h", unit_hash(seed, F.col("traj_id"))).withColumn("cell", F.floor(F.col("h") * 1024))
    sizes = ids.groupBy("cell").agg(F.count("*").alias("c"))
    first = sizes.withColumn("first", F.sum("c").over(Window.orderBy("cell")) - F.col("c"))  # 1024 rows at most
    numbered = ids.join(F.broadcast(first), "cell").select(F.col("traj_id").alias("donor"), (F.col("first") + F.row_number().over(Window.partitionBy("cell").orderBy("h", "traj_id")) - 1).alias("idx"))
    pick = children.withColumn("idx", F.floor(unit_hash(seed, F.col("traj_id"), F.col("child_id")) * n))
    times = pick.join(numbered, "idx").join(pool.select(F.col("traj_id").alias("donor"), F.col("t").alias("dt")), "donor").select("traj_id", (F.col("t") + F.col("dt")).alias("t"))
    roots = children.select("traj_id").distinct().select("traj_id", F.lit(0.0).alias("t"))
    return times.unionByName(children.select("traj_id", "t")).unionByName(roots)


def representatives(draws: DataFrame, x: str, y: str, probs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Draws nearest to each pair of quantiles of two columns, distinct."""
    q, qy = (percentiles(draws, [], c, {f"{c}_{i}": p for i, p in enumerate(probs)}) for c in (x, y))
    q = q.crossJoin(F.broadcast(qy))
    targets = q.select(F.explode(F.array(*[F.struct(F.col(f"{x}_{i}").alias("qx"), F.col(f"{y}_{j}").alias("qy")) for i in range(len(probs)) for j in range(len(probs))])).alias("q")).select("q.*")
    d = F.pow(F.col(x) - F.col("qx"), F.lit(2)) + F.pow(F.col(y) - F.col("qy"), F.lit(2))
    return draws.crossJoin(F.broadcast(targets)).groupBy("qx", "qy").agg(F.min_by("traj_id", F.struct(d, F.col("traj_id"))).alias("traj_id")).select("traj_id").distinct()


def distinct_times(actives: DataFrame) -> DataFrame:
    return actives.select("traj_id", "parent_t").distinct()


def multiplicity(events: DataFrame) -> DataFrame:
    return events.groupBy("t").agg(F.count("*").alias("n"))


def empirical_uncond(entities: DataFrame, events: DataFrame, grid: DataFrame, t_star: float) -> DataFrame:
    """Share of trajectories whose last event is not after t_star + T, with its binomial error; empty ones are over."""
    last = reach(first_post(entities, events, t_star), grid, lambda T: F.col("last_t") > t_star + T)
    rows = reaching(last, grid, [], {"__open": F.count("*")}, {"__open": "n"}).withColumn("p", (F.col("n") - F.col("__open")) / F.col("n"))
    return rows.select("T", "p", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")).alias("se"))


def empirical_cond(entities: DataFrame, events: DataFrame, grid: DataFrame, t_star: float) -> DataFrame:
    """Among trajectories quiet for T the share that stays so for ever; NULL where none is quiet."""
    return cond_from_first(first_post(entities, events, t_star), grid)


def cond_from_first(first: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    rows = reach(first, grid, lambda T: F.col("first_post").isNull() | (F.col("first_post") > T), keys)
    out = reaching(rows, grid, list(keys), {"over": F.count_if(F.col("first_post").isNull()), "n": F.count("*")})
    p = F.when(F.col("n") > 0, F.col("over") / F.col("n"))
    return out.select(*keys, "T", "over", "n", p.alias("p"), F.when(F.col("n") > 0, F.sqrt(p * (1 - p) / F.col("n"))).alias("se"))


def seed_cond(entities: DataFrame, edges: DataFrame, grid: DataFrame, t_star: float) -> DataFrame:
    """As empirical_cond, the first event being the first child of a pair that crosses the cutoff."""
    first = active_at(edges, t_star).groupBy("traj_id").agg((F.min("child_t") - t_star).alias("first_post"))
    return cond_from_first(entities.join(first, "traj_id", "left"), grid)


def extinction(R: np.ndarray, k: np.ndarray, alpha: np.ndarray, theta: np.ndarray, n: int, h: float) -> np.ndarray:
    """Extinction by age of each (R, k, alpha, theta) in a row: H(0) = (b / (b + 1))^k and H(u) = (b / (b + 1 - (f * H)(u)))^k with
    b = k / R, on the grid of step h up to n steps. The recursion runs over all of them at once."""
    f = gamma_pdf_np(h * np.arange(1, n + 1)[None, :], alpha[:, None], theta[:, None]) * h
    beta = k / R
    H = np.empty((len(k), n + 1))
    H[:, 0] = (beta / (beta + 1)) ** k
    for i in range(1, n + 1):
        conv = (f[:, :i] * H[:, i - 1 :: -1]).sum(axis=1) if i > 1 else f[:, 0] * H[:, 0]
        H[:, i] = (beta / np.maximum(beta + 1 - conv, 1e-12)) ** k
    return H


def survival_table(keys: DataFrame, u_max: float, h: float) -> DataFrame:
    """``extinction`` of each distinct (R, k, alpha, theta) up to u_max, as an array."""
    ship(keys.sparkSession)
    n = int(round(u_max / h))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(H=list(extinction(*(b[c].to_numpy(float) for c in KEYS), n, h)))

    return keys.mapInPandas(run, "R double, k double, alpha double, theta double, H array<double>")


KEYS = ("R", "k", "alpha", "theta")
#: Draws, and rows of draws, whose tables are in a task's memory at a time.
DRAWS, ROWS = 2_000, 10_000


def _key_columns(reff: Column) -> list[Column]:
    return [F.round(reff, 6).alias("R"), F.round("k", 6).alias("k"), F.round(F.col("alpha").cast("double"), 6).alias("alpha"), F.round("theta", 6).alias("theta")]


def _by_draw(draws: DataFrame, rows: DataFrame, kernel, n: int, h: float, schema) -> DataFrame:
    """``kernel`` of batches of draws with their rows: the batch, the first row of each draw, ``extinction`` up to n steps of each different key, and of each row's slice the
    rows, their draw and their key. A draw and its rows meet in one task, where the table of its key is made, so tables are never shuffled."""
    named = draws.select("traj_id", F.lit(0).alias("kind"), "R0", (F.col("r") * F.col("R0")).alias("later"), *_key_columns(F.col("r") * F.col("R0")))
    both = named.unionByName(rows.filter("traj_id IS NOT NULL").withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(table: pa.Table, start: np.ndarray) -> Iterator[pa.Table]:
        kind, end = table["kind"].to_numpy(), np.append(start[1:], len(table))
        drawn = kind[start] == 0  # others have no draw
        start, end = start[drawn], end[drawn]
        keys = np.stack([series.floats(table[c])[start] for c in KEYS], 1)
        for at in range(0, len(start), DRAWS):
            first, last = start[at : at + DRAWS], end[at : at + DRAWS]
            own, key = np.unique(keys[at : at + DRAWS], axis=0, return_inverse=True)
            H = extinction(*own.T, n, h)
            draw, place = series.units(np.arange(len(first)), first, last - first)
            there = kind[place] == 1
            draw, place = draw[there], place[there]
            parts = ((place[i : i + ROWS], draw[i : i + ROWS], key.reshape(-1)[draw[i : i + ROWS]]) for i in range(0, len(draw), ROWS))
            yield kernel(table, first, np.array([np.count_nonzero(kind[x:y] == 0) for x, y in zip(first, last, strict=True)]), H, parts)

    return series.by_series(both, ["traj_id"], ["kind"], run, schema)


def seed_uncond(draws: DataFrame, edges: DataFrame, grid: DataFrame, t_star: float, h: float = 0.2, pad: float = 10.0, t_max: float = 20.0) -> DataFrame:
    """Mean over draws of the product of H(t_star + T - s) over crossing seeds s; 0 before the last seed, 1 without seeds."""
    times = np.array(sorted(r["T"] for r in grid.select(F.col("T").cast("double").alias("T")).distinct().collect()))
    n = int(round((t_max + pad) / h))

    def kernel(table: pa.Table, first: np.ndarray, weight: np.ndarray, H: np.ndarray, parts: Iterator[tuple[np.ndarray, ...]]) -> pa.Table:
        logs, last = np.zeros((len(first), len(times))), np.full(len(first), -np.inf)
        seeds = series.floats(table["s"])
        for place, draw, key in parts:
            s = seeds[place]
            pos = np.maximum(t_star + times[None, :] - s[:, None], 0.0) / h
            i = np.minimum(np.floor(pos).astype(np.int64), n)
            w = np.clip(pos - i, 0.0, 1.0)
            v = H[key[:, None], i] * (1 - w) + H[key[:, None], np.minimum(i + 1, n)] * w
            at = series.starts([draw])
            logs[draw[at]] += np.add.reduceat(np.log(np.maximum(v, 1e-300)), at)
            last[draw[at]] = np.maximum(last[draw[at]], np.maximum.reduceat(s, at))
        g = np.where(t_star + times[None, :] < last[:, None], 0.0, np.exp(logs))
        return pa.table({"T": times, "g": (g * weight[:, None]).sum(axis=0), "n": np.full(len(times), weight.sum(), np.int64)})

    rows = active_at(edges, t_star).select("traj_id", F.col("child_t").cast("double").alias("s"))
    sums = _by_draw(draws, rows, kernel, n, h, "T double, g double, n long")
    return sums.groupBy("T").agg((F.sum("g") / F.sum("n")).alias("p"))


def with_reff(parents: DataFrame, draws: DataFrame, t_star: float | Column) -> DataFrame:
    """Parents up to the cutoff with their draw: R of the root is R0, of others r * R0; age at the cutoff."""
    p = parents.filter(F.col("t") <= t_star).join(draws, "traj_id")
    return p.withColumn("Reff", F.when(F.col("is_root"), F.col("R0")).otherwise(F.col("r") * F.col("R0"))).withColumn("age", t_star - F.col("t")).withColumn("alpha", F.col("alpha").cast("double"))


def rao_blackwell(parents: DataFrame, draws: DataFrame, grid: DataFrame, t_star: float | Column, posterior: bool, cdf=gamma_cdf, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (traj_id, T, g_inf, g_quiet): chances that no parent has another child ever, and none within T. ``posterior`` takes the
    children before the cutoff (n_pre) into account. With keys, as of snapshots, the cutoff may be a column, and the grid may have the keys too."""
    ship(draws.sparkSession)
    p = with_reff(parents, draws, t_star)
    beta, k = F.col("k") / F.col("Reff"), F.col("k")
    p = p.withColumn("F0", cdf("age", "alpha", "theta"))
    if posterior:
        p = p.withColumn("kk", k + F.col("n_pre")).withColumn("b", beta + F.col("F0"))
    else:
        p = p.withColumn("kk", k).withColumn("b", beta)
    by, own = [*keys, "traj_id"], [k for k in keys if k in grid.columns]
    inf = p.groupBy(*by).agg(F.exp(F.sum(F.col("kk") * F.log(F.col("b") / (F.col("b") + 1 - F.col("F0"))))).alias("g_inf"))
    p = p.select(*by, "kk", "b", "F0", "age", "alpha", "theta")
    rows = (p.join(grid, own) if own else grid_cross(p, grid)).withColumn("mu", cdf(F.col("age") + F.col("T"), F.col("alpha"), F.col("theta")) - F.col("F0"))
    quiet = rows.groupBy(*by, "T").agg(F.exp(F.sum(F.col("kk") * F.log(F.col("b") / (F.col("b") + F.col("mu"))))).alias("g_quiet"))
    return quiet.join(inf, by)


def snapshot_parents(parents: DataFrame, edges: DataFrame, snaps: DataFrame) -> DataFrame:
    """Parents of each snapshot (snap_id, t_star) that has begun by then, with n_pre of that time: columns snap_id and t_star are added.

    A child is counted once, at the first snapshot that has it, and those counts are added along the snapshots; edges are shuffled once whatever
    the number of snapshots, and a parent is repeated only in the task that has its counts."""
    points = snaps.filter("t_star IS NOT NULL").agg(F.array_sort(F.collect_list(F.struct("t_star", "snap_id"))).alias("__snaps"))
    kids = edges.filter(F.col("child_t") > F.col("parent_t")).select("traj_id", "parent_id", "child_t").crossJoin(F.broadcast(points))
    kids = kids.select("traj_id", "parent_id", F.size(F.filter("__snaps", lambda s: s["t_star"] < F.col("child_t"))).alias("__from"))
    counts = kids.groupBy("traj_id", "parent_id", "__from").agg(F.count("*").alias("__c"))
    counts = counts.groupBy("traj_id", "parent_id").agg(F.collect_list(F.struct("__from", "__c")).alias("__counts"))
    rows = parents.join(counts, ["traj_id", "parent_id"], "left").crossJoin(F.broadcast(points))
    rows = rows.select(*parents.columns, "__counts", F.posexplode("__snaps").alias("__pos", "__snap")).filter(F.col("t") <= F.col("__snap.t_star"))
    n = F.aggregate(F.filter("__counts", lambda x: x["__from"] <= F.col("__pos")), F.lit(0).cast("long"), lambda a, x: a + x["__c"])
    return rows.select(*parents.columns, F.col("__snap.snap_id").alias("snap_id"), F.col("__snap.t_star").alias("t_star"), F.coalesce(n, F.lit(0).cast("long")).alias("n_pre"))


def snapshot_curves(parents: DataFrame, edges: DataFrame, draws: DataFrame, snaps: DataFrame, grid: DataFrame, posterior: bool = True, cdf=gamma_cdf) -> DataFrame:
    """The conditional curve of each snapshot (snap_id, t_star), all in one plan: snap_id, t_star, T, p and the number n of draws with a parent by
    then. The grid has column T, and snap_id where each snapshot has times of its own, as up to the next one (``curves.segment_grid``)."""
    keys = ("snap_id", "t_star")
    own = grid.select(*[c for c in ("snap_id", "T") if c in grid.columns])
    rb = rao_blackwell(snapshot_parents(parents, edges, snaps), draws, own, F.col("t_star"), posterior, cdf, keys)
    return rb_cond_curve(rb, keys).select(*keys, "T", "p", "n")


def rb_cond_curve(rb: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ratio of means by T."""
    return rb.groupBy(*keys, "T").agg((F.avg("g_inf") / F.avg("g_quiet")).alias("p"), F.count("*").alias("n"))


def rb_uncond(parents: DataFrame, draws: DataFrame, grid: list[float], t_star: float, h: float = 0.2, pad: float = 10.0) -> DataFrame:
    """Per-draw chances (traj_id, T, g) that all descendants of the parents end by T: with psi(T) = int f(D+s)(1-H(T-s)) ds + 1 - F(D+T)
    the product of (b / (b + psi))^k over parents, after the children before the cutoff are taken into account. H is tabulated once a
    distinct key of a batch of draws; a batch of parents is one convolution."""
    n = int(round((max(grid) + pad) / h))
    near = [min(int(x / h + 1e-9), n - 1) for x in grid]  # psi is needed at the points of the table on both sides of each T only
    points = sorted({i for x in near for i in (x, x + 1)})
    left = np.array([points.index(i) for i in near])
    share = np.asarray(grid, float) / h - np.array(near)

    def kernel(table: pa.Table, first: np.ndarray, weight: np.ndarray, H: np.ndarray, parts: Iterator[tuple[np.ndarray, ...]]) -> pa.Table:
        sums, some = np.zeros((len(first), len(grid))), np.zeros(len(first), bool)
        t, root, pre = series.floats(table["t"]), table["is_root"].fill_null(False).to_numpy(), series.floats(table["n_pre"])
        R0, later, ks, alpha, theta = (series.floats(table[c])[first] for c in ("R0", "later", "k", "alpha", "theta"))
        for place, draw, key in parts:
            age, a, th, k, m = (t_star - t[place])[:, None], alpha[draw][:, None], theta[draw][:, None], ks[draw][:, None], pre[place][:, None]
            R = np.where(root[place], R0[draw], later[draw])[:, None]
            own = 1 - H[key]
            f = gamma_pdf_np(age + h * np.arange(1, points[-1] + 1)[None, :], a, th) * h
            psi = 1 - gamma_cdf_np(age + h * np.array(points)[None, :], a, th)
            for at, i in enumerate(points):
                if i:
                    psi[:, at] += np.einsum("ij,ij->i", f[:, :i], own[:, i - 1 :: -1] if i == own.shape[1] else own[:, :i][:, ::-1])
            beta = k / R + gamma_cdf_np(age, a, th)
            logs = (k + m) * np.log(beta / (beta + psi))
            at = series.starts([draw])
            sums[draw[at]] += np.add.reduceat(logs[:, left] * (1 - share) + logs[:, left + 1] * share, at)
            some[draw] = True
        g = pa.array(np.exp(sums[some]).reshape(-1))
        ends = pa.array(np.arange(int(some.sum()) + 1, dtype=np.int32) * len(grid))
        return pa.table({"traj_id": table["traj_id"].take(pa.array(first[some])), "g": pa.ListArray.from_arrays(ends, g)})

    rows = parents.filter(F.col("t") <= t_star).select("traj_id", F.col("t").cast("double").alias("t"), "is_root", F.col("n_pre").cast("long").alias("n_pre"))
    kinds = StructType([StructField("traj_id", draws.schema["traj_id"].dataType), StructField("g", ArrayType(DoubleType()))])
    flat = _by_draw(draws, rows, kernel, n, h, kinds).select("traj_id", F.posexplode("g").alias("i", "g"))
    return flat.select("traj_id", F.element_at(F.array(*[F.lit(float(x)) for x in grid]), (F.col("i") + 1).cast("int")).alias("T"), "g")


def lineage_draws(draws: DataFrame, effective: bool = True) -> DataFrame:
    """Draws as the lineage methods take them: R is the effective number r * R0, or R0 itself for an epidemic without control."""
    R = F.col("r") * F.col("R0") if effective else F.col("R0")
    return draws.select("traj_id", R.alias("R"), "k", F.col("alpha").cast("double").alias("alpha"), "theta")


def lineage_quiet(draws: DataFrame, actives: DataFrame, grid: DataFrame, t_star: float, method: str = "ev", cdf=gamma_cdf, effective: bool = True) -> DataFrame:
    """Per draw and T the chance that quiet lineages are over. ``size_only`` takes the number of active parents, ``ev`` their ages,
    shifted by the mean generation time. 1 without actives."""
    ship(draws.sparkSession)
    d = lineage_draws(draws, effective)
    a = distinct_times(actives)
    clipped = lambda g: F.least(F.lit(1.0), g)
    if method == "size_only":
        n = a.groupBy("traj_id").agg(F.count("*").alias("n"))
        rows = grid_cross(d.join(n, "traj_id", "left"), grid).withColumn("F", cdf("T", "alpha", "theta"))
        ratio = (1 + F.col("R") / F.col("k")) / (1 + F.col("R") * F.col("F") / F.col("k"))
        return rows.select("traj_id", "T", F.when(F.col("n").isNull(), 1.0).otherwise(clipped(F.exp(-F.col("k") * F.col("n") * F.log(ratio)))).alias("g"))
    p = a.join(d, "traj_id").withColumn("age", F.greatest(F.lit(0.0), F.lit(t_star) - F.col("parent_t") - F.col("alpha") * F.col("theta"))).withColumn("F0", cdf("age", "alpha", "theta"))
    rows = grid_cross(p, grid).withColumn("F1", cdf(F.col("age") + F.col("T"), F.col("alpha"), F.col("theta")))
    A, B = 1 + F.col("R") / F.col("k") * (1 - F.col("F0")), 1 + F.col("R") / F.col("k") * (F.col("F1") - F.col("F0"))
    per = rows.groupBy("traj_id", "T").agg(clipped(F.exp(F.sum(-F.col("k") * F.log(A / B)))).alias("g"))
    return grid_cross(d.select("traj_id"), grid).join(per, ["traj_id", "T"], "left").withColumn("g", F.coalesce("g", F.lit(1.0)))


def lineage_quiet_removal(draws: DataFrame, actives: DataFrame, grid: DataFrame, t_star: float, kind: str, rate: float, shape: float = 1.0, method: str = "ev", effective: bool = True) -> DataFrame:
    return lineage_quiet(draws, actives, grid, t_star, method, thinned_gamma_cdf(kind, rate, shape), effective)


def level_bands(df: DataFrame, value: str, levels: tuple[float, ...], centre: str = "median") -> DataFrame:
    """By T the median or mean p of ``value`` and for each level a column lo_ and hi_ with the level in percent: the equal-tailed band."""
    probs = {f"{end}_{round(100 * x)}": 0.5 + side * x / 2 for x in sorted(levels) for end, side in (("lo", -1), ("hi", 1))}
    if centre == "median":
        return percentiles(df, ["T"], value, {"p": 0.5} | probs)
    return attach(df.groupBy("T").agg(F.avg(value).alias("p")), percentiles(df, ["T"], value, probs), ["T"])


def log_survival(draws: DataFrame, actives: DataFrame, grid: DataFrame, t_star: float, horizon: float | None, effective: bool = True) -> DataFrame:
    """Per draw and T: ls = log S(T) and lh = log S(horizon) of the first event after the cutoff."""
    ship(draws.sparkSession)
    d = lineage_draws(draws, effective)
    p = distinct_times(actives).join(d, "traj_id").withColumn("age", F.greatest(F.lit(0.0), F.lit(t_star) - F.col("parent_t"))).withColumn("F0", gamma_cdf("age", "alpha", "theta"))
    p = p.withColumn("Fh", F.lit(1.0) if horizon is None else gamma_cdf(F.col("age") + horizon, F.col("alpha"), F.col("theta")))
    rows = grid_cross(p, grid).withColumn("F1", gamma_cdf(F.col("age") + F.col("T"), F.col("alpha"), F.col("theta")))
    part = lambda f: F.sum(-F.col("k") * F.log(1 + F.col("R") / F.col("k") * F.greatest(F.col(f) - F.col("F0"), F.lit(0.0))))
    per = rows.groupBy("traj_id", "T").agg(part("F1").alias("ls"), part("Fh").alias("lh"))
    return grid_cross(d.select("traj_id"), grid).join(per, ["traj_id", "T"], "left").select("traj_id", "T", F.coalesce("ls", F.lit(0.0)).alias("ls"), F.coalesce("lh", F.lit(0.0)).alias("lh"))


def first_after(logs: DataFrame, agg: str = "median", probs: tuple[float, ...] = (0.05, 0.95)) -> DataFrame:
    """P(T) = S(horizon) / S(T) over draws: median or mean, with percentile bands."""
    p = logs.withColumn("p", F.exp(F.col("lh") - F.col("ls")))
    if agg == "median":
        return percentiles(p, ["T"], "p", {"p": 0.5, "lo": probs[0], "hi": probs[1]})
    return attach(p.groupBy("T").agg(F.avg("p").alias("p")), percentiles(p, ["T"], "p", {"lo": probs[0], "hi": probs[1]}), ["T"])


def first_after_mixture(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of S(horizon) over sum of S(T), in logarithms."""
    top = logs.groupBy(*keys, "T").agg(F.max("lh").alias("mh"), F.max("ls").alias("ms"))
    r = attach(logs, top, [*keys, "T"]).groupBy(*keys, "T").agg(F.first("mh").alias("mh"), F.first("ms").alias("ms"), F.sum(F.exp(F.col("lh") - F.col("mh"))).alias("a"), F.sum(F.exp(F.col("ls") - F.col("ms"))).alias("b"))
    return r.select(*keys, "T", F.exp(F.col("mh") + F.log("a") - F.col("ms") - F.log("b")).alias("p"))


POISSON_CUTS = np.cumsum([np.exp(-1) / np.prod(np.arange(1, i + 1)) for i in range(8)])  # chances of up to i at mean 1


def bootstrap_bands(logs: DataFrame, B: int, seed: int, probs: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Percentile bands of the mixture over B resamples of the draws. A draw's count in a resample is Poisson(1) by a hash, the limit of
    multinomial counts, so that no index over all draws is needed."""
    u = unit_hash(seed, F.col("traj_id"), F.col("b"))
    count = sum((F.when(u >= float(c), 1).otherwise(0) for c in POISSON_CUTS), F.lit(0))
    rows = logs.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1)))).withColumn("c", count).filter("c > 0")
    # Shifted by the largest values of each T, as sums of very small chances would be 0.
    top = logs.groupBy("T").agg(F.max("lh").alias("mh"), F.max("ls").alias("ms"))
    rows = attach(rows, top, ["T"])
    per = rows.groupBy("b", "T").agg((F.sum(F.col("c") * F.exp(F.col("lh") - F.col("mh"))) / F.sum(F.col("c") * F.exp(F.col("ls") - F.col("ms")))).alias("q"), F.exp(F.first("mh") - F.first("ms")).alias("f"))
    per = per.select("T", (F.col("q") * F.col("f")).alias("p"))
    return per.groupBy("T").agg(F.percentile("p", F.lit(probs[0])).alias("lo"), F.percentile("p", F.lit(probs[1])).alias("hi"))


#: Least logarithm of a chance that counts: that of the smallest normal double.
LEAST_LOG = float(np.log(np.finfo(float).tiny))


def hazard_summary(draws: DataFrame, actives: DataFrame, t_star: float, effective: bool = True) -> DataFrame:
    """One row a draw on the hazard of the first event after the cutoff, from the ages of its active parents: A, the log chance of none
    ever, with its sign changed; h0 and h1, hazard and slope at the cutoff; m1 and m2, the moments of waiting times beyond the ages, R times the sum of
    E[(tau - age)+] and of its square. All 0 without actives.

    The upper incomplete gamma function at shapes one and two higher follows from that at the shape and the density, so one
    distribution function and one density a parent are enough. A parent at the cutoff itself, with a shape below 1, has an unbounded
    density and counts as one of age 1e-12."""
    ship(draws.sparkSession)
    p = distinct_times(actives).join(lineage_draws(draws, effective), "traj_id").withColumn("age", F.greatest(F.lit(0.0), F.lit(t_star) - F.col("parent_t")))
    p = p.withColumn("age", F.when((F.col("alpha") < 1) & (F.col("age") < 1e-12), 1e-12).otherwise(F.col("age")))
    a, th, age, R, k = (F.col(c) for c in ("alpha", "theta", "age", "R", "k"))
    p = p.withColumn("q", 1 - gamma_cdf("age", "alpha", "theta"))
    p = p.withColumn("f", F.when(age > 0, gamma_pdf("age", "alpha", "theta")).when(a == 1, 1 / th).otherwise(0.0))
    f, x = F.col("f"), age / th
    slope = F.when(age > 0, f * ((a - 1) / age - 1 / th)).otherwise(-f / th)
    q0 = F.col("q")
    q1 = q0 + f * th * x / a
    q2 = q1 + f * th * x * x / (a * (a + 1))
    mean, square = th * a * q1, th * th * a * (a + 1) * q2
    sums = p.groupBy("traj_id").agg(
        F.sum(k * F.log(1 + R / k * q0)).alias("A"), F.sum(R * f).alias("h0"), F.sum(R * slope - R * R / k * f * f).alias("h1"),
        F.sum(R * (mean - age * q0)).alias("m1"), F.sum(R * (square - 2 * age * mean + age * age * q0)).alias("m2"),
    )
    out = draws.select("traj_id").join(sums, "traj_id", "left")
    return out.select("traj_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("A", "h0", "h1", "m1", "m2")])


def first_after_surrogate(draws: DataFrame, actives: DataFrame, grid: DataFrame, t_star: float, method: str, horizon: float | None = None, rho: float = 3.0, effective: bool = True) -> DataFrame:
    """Mixture curve with the survival of each draw replaced: ``exact``; ``gompertz``, a hazard h0 exp(-h0 T / A); ``two_exp``, a hazard of two
    decays with the ratio ``rho`` of rates that matches value, slope and integral, or gompertz where weights or rates are not
    positive; ``gamma_moment`` exp(-A G(T)) with G the gamma distribution of the mean and variance of waiting times beyond the
    parents' ages. ``horizon`` ends the period, None never. Draws without hazard have survival 1."""
    if rho <= 1:
        raise ValueError("rho must be above 1")
    if method == "exact":
        return first_after_mixture(log_survival(draws, actives, grid, t_star, horizon, effective))
    s = hazard_summary(draws, actives, t_star, effective)
    A, h0, h1 = F.col("A"), F.col("h0"), F.col("h1")
    some = A > 0
    gone = lambda b, t: F.lit(1.0) if t is None else 1 - F.exp(-b * t)
    if method == "gamma_moment":
        s = s.withColumn("mean", F.when(some, F.col("m1") / A)).withColumn("var", F.greatest(F.when(some, F.col("m2") / A) - F.col("mean") * F.col("mean"), F.lit(1e-12)))
        s = s.withColumn("ga", F.greatest(F.col("mean") * F.col("mean") / F.col("var"), F.lit(1e-9))).withColumn("gth", F.greatest(F.col("var") / F.greatest("mean", F.lit(1e-12)), F.lit(1e-9)))
        at = lambda t: F.lit(1.0) if t is None else gamma_cdf(t, F.col("ga"), F.col("gth"))
        hazard = lambda t: A * at(t)
    elif method == "gompertz":
        hazard = lambda t: A * gone(F.when(some, h0 / A), t)
    else:
        # Both decays: t1 + t2 = h0, t1 / b1 + t2 / b2 = A and -t1 b1 - t2 b2 = h1 with b2 = rho b1.
        s = s.withColumn("disc", h0 * h0 * (rho + 1) ** 2 + 4 * rho * A * h1)
        s = s.withColumn("b1", F.when(some & (F.col("disc") >= 0), (h0 * (rho + 1) + F.sqrt(F.greatest("disc", F.lit(0.0)))) / (2 * rho * A)))
        s = s.withColumn("t2", F.when(F.col("b1") > 0, -(h0 + h1 / F.col("b1")) / (rho - 1))).withColumn("t1", h0 - F.col("t2"))
        fits = F.coalesce((F.col("t1") > 0) & (F.col("t2") > 0), F.lit(False))
        b1, b2 = F.col("b1"), rho * F.col("b1")
        hazard = lambda t: F.when(fits, F.col("t1") / b1 * gone(b1, t) + F.col("t2") / b2 * gone(b2, t)).otherwise(A * gone(F.when(some, h0 / A), t))
    end = None if horizon is None else F.lit(float(horizon))
    logs = lambda t: F.when(some, F.greatest(-hazard(t), F.lit(LEAST_LOG))).otherwise(0.0)
    s = s.withColumn("lh", logs(end))
    out = first_after_mixture(grid_cross(s, grid).select("traj_id", "T", logs(F.col("T")).alias("ls"), "lh"))
    return out.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p"))))


def parametric_quiet(parents: DataFrame, draws: DataFrame, grid: DataFrame, t_star: float, control: float | None = None) -> DataFrame:
    """Median over draws of the product of ((b + F(a + T)) / (b + 1))^(k + M) over parents; M are children before the cutoff. R is R0 if
    the cutoff is before the control date, r * R0 for others than the root afterwards."""
    ship(draws.sparkSession)
    p = with_reff(parents, draws, t_star)
    R = F.col("R0") if control is not None and t_star < control else F.col("Reff")
    p = p.withColumn("b", F.col("k") / R).select("traj_id", "b", "age", "alpha", "theta", (F.col("k") + F.col("n_pre")).alias("kk"))
    rows = grid_cross(p, grid).withColumn("F1", gamma_cdf(F.col("age") + F.col("T"), F.col("alpha"), F.col("theta")))
    per = rows.groupBy("traj_id", "T").agg(F.exp(F.sum(F.col("kk") * F.log((F.col("b") + F.col("F1")) / (F.col("b") + 1)))).alias("g"))
    return percentiles(per, ["T"], "g", {"p": 0.5}, n="n").select("T", "p", "n")


def ultimate(draws: DataFrame) -> DataFrame:
    return draws.select("traj_id", ultimate_extinction(F.col("R0"), F.col("k")).alias("q"))


def compare_estimators(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """One long table (target, estimator, T, p)."""
    out = None
    for (target, name), t in tables.items():
        part = t.select(F.lit(target).alias("target"), F.lit(name).alias("estimator"), "T", "p")
        out = part if out is None else out.unionByName(part)
    return out
