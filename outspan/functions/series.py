"""Acceptance windows, segments and scores of whole series in NumPy: a batch of series at a time, flat arrays with the number of the series (or of
the unit, a series with one of its options) beside each value. ``by_series`` deals rows to tasks once and hands whole series on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

#: Values that the units made at a time may have; a unit of more is made alone.
BLOCK = 400_000


def starts(values: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal codes begin."""
    n = len(values[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in values:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Numbers that differ where neighbouring values differ."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    found = column.dictionary_encode(null_encoding="encode")
    return (found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found).indices.to_numpy(zero_copy_only=False)


def by_series(rows: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema) -> DataFrame:
    """``kernel`` of tables of whole groups of ``keys``, with the start of each, in ``order`` inside. Rows are shuffled once; a task holds a batch and its longest group."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            for out in kernel(table, starts([codes(table[k]) for k in keys])):
                if out.num_rows:
                    yield from out.to_batches()

        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            first = [b[k][0].as_py() for k in keys]
            if held and first != key:
                yield from done(held)
                held = []
            cut = int(starts([codes(b[k]) for k in keys])[-1])
            if cut:
                yield from done([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
            key = [b[k][b.num_rows - 1].as_py() for k in keys]
        if held:
            yield from done(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def floats(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles, not-a-number where null."""
    return np.asarray(column.cast(pa.float64()).to_numpy(), float)


def _edges(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row is the first and the last of its group; rows are in the order of their groups."""
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    last = np.ones(len(g), bool)
    last[:-1] = first[1:]
    return first, last


def _running_max(v: np.ndarray, g: np.ndarray) -> np.ndarray:
    out, k = v.copy(), 1
    longest = np.diff(np.append(starts([g]), len(g))).max(initial=0)
    while k < longest:
        before = np.where(g[k:] == g[:-k], out[:-k], -np.inf)
        out[k:] = np.maximum(out[k:], before)
        k *= 2
    return out


def _grouped(values: np.ndarray, g: np.ndarray, count: int, at: np.ufunc, none: float) -> np.ndarray:
    out = np.full(count, none, values.dtype)
    if len(g):
        s = starts([g])
        out[g[s]] = at.reduceat(values, s)
    return out


class Days:
    """Counts by day of a batch of series, and what of them lies in windows: each day's count is spread evenly over the day."""

    def __init__(self, s: np.ndarray, d: np.ndarray, n: np.ndarray, count: int):
        day = np.floor(d)
        at = starts([s, day])
        self.s, self.day = s[at], day[at]
        self.c = np.add.reduceat(n, at) if len(at) else np.zeros(0)
        self.upto = np.concatenate([[0.0], np.cumsum(self.c)])
        # Days are ranks in one list of all different days, so that a series and a day make one whole number.
        self.all = np.unique(self.day)
        self.width = len(self.all) + 1
        self.key = self.s * self.width + np.searchsorted(self.all, self.day)

    def mass(self, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.c):
            return np.zeros(len(a))
        fa, fb = np.floor(a), np.floor(b)
        place = lambda x, side: np.searchsorted(self.key, s * self.width + np.searchsorted(self.all, x, side))
        ia, ja, ib, jb = place(fa, "left"), place(fa, "right"), place(fb, "left"), place(fb, "right")
        c = np.append(self.c, 0.0)
        ca, cb = np.where(ja > ia, c[ia], 0.0), np.where(jb > ib, c[ib], 0.0)
        whole = np.where(ib > ja, self.upto[np.maximum(ib, ja)] - self.upto[ja], 0.0)
        apart = ca * (fa + 1 - a) + whole + cb * (b - fb)
        return np.where(b <= a, 0.0, np.where(fa == fb, ca * (b - a), apart))


def band(y: np.ndarray, m: np.ndarray, N: np.ndarray, o: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``windows.band``: lower and upper counts; a series without counts has bounds of 0."""
    z = o["z_alpha"]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = y / N
        h = z * np.sqrt(p * (1 - p) / N + z * z / (4 * N * N)) / (1 + z * z / N) / np.maximum(p, o["eps_share"])
    p = o["baseline_p"] + np.fmin(o["h_max"], h)
    return np.maximum(0, np.floor((1 - p) * m)).astype(np.int64), np.ceil((1 + p) * m).astype(np.int64)


def clusters(g: np.ndarray, d: np.ndarray, least: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``windows.cluster_windows``: half a window is at least ``least``; both arguments stand beside each observation."""
    first, last = _edges(g)
    gap = np.diff(d, prepend=0.0)
    near = np.where(first, 0.0, gap) + np.where(last, 0.0, np.append(gap[1:], 0.0))
    side = np.where(first & last, 0.0, np.where(first | last, weight * near / 2, weight * near / 4))
    half = np.maximum(least, side)
    a, b = d - half, d + half
    order = np.lexsort((b, a, g))
    g, a, b = g[order], a[order], b[order]
    before = np.append(-np.inf, _running_max(b, g)[:-1]) if len(g) else b
    new = np.flatnonzero(_edges(g)[0] | (a > before))
    return (g[new], a[new], np.maximum.reduceat(b, new)) if len(new) else (g, a, b)


def gaps(g: np.ndarray, a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``windows.gap_windows`` of clusters in their order."""
    if not len(g):
        return g, a, b
    follows = ~_edges(g)[1]
    nxt = np.append(a[1:], 0.0)
    width = (b - a)[np.lexsort((b - a, g))]
    s = starts([g])
    m = np.diff(np.append(s, len(g)))
    lo, hi = width[s + (m - 1) // 2], width[s + m // 2]
    med = np.repeat(np.where(lo == hi, lo, 0.5 * lo + 0.5 * hi), m)
    half = np.minimum(scale * (nxt - b), med / 2)
    at = np.flatnonzero(follows & (half > 1e-3))
    mid = ((b + nxt) / 2)[at]
    return g[at], mid - half[at], mid + half[at]


def fold(g: np.ndarray, a: np.ndarray, b: np.ndarray, L: np.ndarray, U: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """``windows.fold_bounds`` of each group and interval, in their order."""
    order = np.lexsort((U, L, rank, b, a, g))
    g, a, b, L, U = (x[order] for x in (g, a, b, L, U))
    s = starts([g, a, b])
    size = np.diff(np.append(s, len(g)))
    l, u = L[s], U[s]  # noqa: E741
    for k in range(1, size.max(initial=0)):
        at = np.flatnonzero(size > k)
        nl, nu = L[s[at] + k], U[s[at] + k]
        meet = np.maximum(l[at], nl) <= np.minimum(u[at], nu)
        l[at], u[at] = np.where(meet, np.maximum(l[at], nl), np.minimum(l[at], nl)), np.where(meet, np.minimum(u[at], nu), np.maximum(u[at], nu))
    return g[s], a[s], b[s], l, u


def acceptance(s: np.ndarray, g: np.ndarray, d: np.ndarray, days: Days, N: np.ndarray, o: dict[str, np.ndarray], cuts: tuple[np.ndarray, ...], longest: int = 5) -> tuple[np.ndarray, ...]:
    """``windows.acceptance_windows`` of units: observations ``d`` with their unit ``g``, of each unit its series ``s``, count ``N`` and options ``o``. ``cuts`` are
    the segments (unit, a, b) of the units that want them."""
    count = len(s)
    of = lambda g, *names: {k: o[k][g] for k in (names or ("z_alpha", "eps_share", "h_max", "baseline_p"))}
    first, last = _grouped(d, g, count, np.minimum, np.nan), _grouped(d, g, count, np.maximum, np.nan)
    start = np.minimum(first, 0.0)
    cg, ca, cb = clusters(g, d, (o["z_beta"] * o["sigma_days"])[g], o["neighbor_weight"][g])
    keep = np.isin(o["strategy"], ("both", "cluster"))[cg]
    cg, ca, cb = cg[keep], ca[keep], cb[keep]
    gg, ga, gb = gaps(cg, ca, cb, o["gap_scale"][cg])
    keep = o["include_gap_windows"][gg]
    g, a, b = (np.concatenate(x) for x in zip((cg, ca, cb), (gg[keep], ga[keep], gb[keep]), cuts, strict=True))
    order = np.lexsort((b, a, g))
    g, a, b = g[order], a[order], b[order]
    at = starts([g, a, b])
    g, a, b = g[at], a[at], b[at]
    M = days.mass(s[g], a, b)
    L, U = band(M, M, N[g], of(g))
    a, b = np.maximum(a, start[g]), np.minimum(b, last[g])
    snap = o["day_snap"][g]
    a, b = np.where(snap, np.floor(a), a), np.where(snap, np.ceil(b), b)
    at = np.flatnonzero(b > a)
    out = fold(g[at], a[at], b[at], L[at], U[at], np.zeros(len(at), int))
    parts = [(*out, np.zeros(len(out[0]), int))]
    # Unions of consecutive windows without a gap above a day.
    at = np.flatnonzero(o["include_union_windows"][out[0]])
    g, a, b, L, U = (x[at] for x in out)
    if len(g):
        run = np.cumsum(_edges(g)[0] | (a - np.append(b[0], b[:-1]) > 1))
        cL, cU = np.append(0, np.cumsum(L)), np.append(0, np.cumsum(U))
        i = np.concatenate([np.flatnonzero(run[k:] == run[: len(run) - k]) for k in range(min(longest, len(run)))])
        j = i + np.repeat(np.arange(min(longest, len(run))), [np.count_nonzero(run[k:] == run[: len(run) - k]) for k in range(min(longest, len(run)))])
        g, a, b, sL, sU = g[i], a[i], b[j], cL[j + 1] - cL[i], cU[j + 1] - cU[i]
        M = days.mass(s[g], a, b)
        L, U = band(M, M, N[g], of(g))
        L, U = np.maximum(L, sL), np.minimum(U, sU)
        gain = (sU - sL) - (U - L)
        at = np.flatnonzero((gain > 0) & (L <= U))
        g, a, b, L, U, sL, sU, gain = (x[at] for x in (g, a, b, L, U, sL, sU, gain))
        order = np.lexsort((sU, sL, b, a, -gain, g))
        g, a, b, L, U, sL, sU = (x[order] for x in (g, a, b, L, U, sL, sU))
        at = starts([g, a, b, sL, sU])
        g, a, b, L, U = (x[at] for x in (g, a, b, L, U))
        if len(g):
            f = starts([g])
            at = np.arange(len(g)) - np.repeat(f, np.diff(np.append(f, len(g)))) < o["max_unions_to_keep"][g]
            parts.append((g[at], a[at], b[at], L[at], U[at], np.ones(int(at.sum()), int)))
    u = np.flatnonzero(o["include_global_total"] & ~np.isnan(last))
    L, U = band(N[u], N[u], N[u], of(u))
    parts.append((u, start[u], last[u], L, U, np.full(len(u), 2)))
    return fold(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def interpolant(s: np.ndarray, d: np.ndarray, n: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """``windows.monotone_interpolant`` in NumPy: series, number, time and value of each grid point; ``step`` of each series."""
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)
    if not len(s):
        return none
    at = starts([s, d])
    s, d, n = s[at], d[at], np.add.reduceat(n, at)
    f = starts([s])
    size = np.diff(np.append(f, len(s)))
    keep = np.repeat(size >= 2, size)
    s, d, n = s[keep], d[keep], n[keep]
    if not len(s):
        return none
    f = starts([s])
    size = np.diff(np.append(f, len(s)))
    total = np.cumsum(n)
    y = total - np.repeat(total[f] - n[f], size)
    first, last = _edges(s)
    pos = np.arange(len(s)) - np.repeat(f, size)
    left = np.repeat(size, size) - 1 - pos  # knots that follow
    back = lambda v, k: np.where(pos >= k, np.concatenate([np.zeros(min(k, len(v))), v[:-k]]), np.nan)
    ahead = lambda v, k: np.where(left >= k, np.concatenate([v[k:], np.zeros(min(k, len(v)))]), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        h1 = ahead(d, 1) - d
        s1 = (ahead(y, 1) - y) / h1
        h0, s0, h2, s2, hm, sm = back(h1, 1), back(s1, 1), ahead(h1, 1), ahead(s1, 1), back(h1, 2), back(s1, 2)

        def end(ha, hb, sa, sb):
            m = ((2 * ha + hb) * sa - ha * sb) / (ha + hb)
            out = np.where((np.sign(sa) != np.sign(sb)) & (np.abs(m) > 3 * np.abs(sa)), 3 * sa, m)
            return np.where(np.isnan(sb), sa, np.where(np.sign(m) != np.sign(sa), 0.0, out))

        w1, w2 = 2 * h1 + h0, h1 + 2 * h0
        inner = np.where(s0 * s1 <= 0, 0.0, (w1 + w2) / (w1 / s0 + w2 / s1))
        m = np.where(np.isnan(s0), end(h1, h2, s1, s2), np.where(np.isnan(s1), end(h0, hm, s0, sm), inner))
    x0, own = np.repeat(d[f], size), step[s]
    lo = np.ceil((d - x0) / own - 1e-9).astype(np.int64)
    hi = np.where(last, lo, np.ceil((np.append(d[1:], 0.0) - x0) / own - 1e-9).astype(np.int64) - 1)
    points = np.maximum(hi - lo + 1, 0)
    k = np.repeat(np.arange(len(s)), points)
    i = lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(points) - points, points)
    x = x0[k] + i * own[k]
    keep = ~last[k] | (np.abs(x - d[k]) < 1e-9)
    k, i, x = k[keep], i[keep], x[keep]
    h = np.where(last[k], 1.0, np.append(d[1:], 0.0)[k] - d[k])
    t = np.maximum(0.0, (x - d[k]) / h)
    t3, t2 = t**3, t**2
    y1, m1 = np.where(last, y, np.append(y[1:], 0.0)), np.where(last, 0.0, np.append(m[1:], 0.0))
    v = (2 * t3 - 3 * t2 + 1) * y[k] + (t3 - 2 * t2 + t) * h * m[k] + (3 * t2 - 2 * t3) * y1[k] + (t3 - t2) * h * m1[k]
    return s[k], i, x, v


def chords(x: np.ndarray, v: np.ndarray, least: int, kmax: int) -> list[tuple[float, float]]:
    """Ends of the best fit of one series' curve by 1 to kmax chords, each at least ``least`` steps long, none for a shorter series."""
    n = len(x)
    if n - 1 < least:
        return []
    cum = lambda z: np.concatenate([[0.0], np.cumsum(z)])
    s1, sx, sxx, sv, svv, sxv = cum(np.ones(n)), cum(x), cum(x * x), cum(v), cum(v * v), cum(x * v)

    def costs(at: int, to: int) -> np.ndarray:
        """Squared errors of the chords from the points before ``to`` to those from ``at`` on; infinite where a chord is too short."""
        j, i = np.arange(at, to), np.arange(to)[:, None]
        gap = x[j] - x[i]
        b = (v[j] - v[i]) / np.where(gap > 0, gap, 1.0)
        a = v[i] - b * x[i]
        d = lambda s: s[j + 1] - s[i]
        error = d(svv)
        for part in (a * a * d(s1), b * b * d(sxx)):
            error += part
        for part in (2 * a * d(sv), 2 * b * d(sxv)):
            error -= part
        error += 2 * a * b * d(sx)
        np.maximum(0.0, error, out=error)
        error[j - i < least] = np.inf
        return error

    best = np.full((kmax + 1, n), np.inf)
    back = np.zeros((kmax + 1, n), int)
    best[0, 0] = 0.0
    for at in range(0, n, 128):  # a block of ends at a time bounds memory for long series
        to = min(n, at + 128)
        # The last chord of the most is asked for at the last point alone.
        error = costs(at, to)
        own = error[0]
        best[1, at:to], back[1, at:to] = own, 0
        for K in range(2, kmax + (to == n)):
            cols = slice(at, to) if K < kmax else slice(n - 1, n)
            part = error[:, cols.start - at : cols.stop - at]
            # Starts of a K-th chord lie before its end, so within this block those of fewer chords are settled.
            total = best[K - 1, :to, None] + part
            back[K, cols] = where = total.argmin(axis=0)
            best[K, cols] = total[where, np.arange(total.shape[1])]
    score = [n * np.log(max(best[K, n - 1] / n, 1e-12)) + 2 * K * np.log(n) if np.isfinite(best[K, n - 1]) else np.inf for K in range(1, kmax + 1)]
    K, j, ends = int(np.argmin(score)) + 1, n - 1, []
    while K:
        i = back[K, j]
        ends.append((x[i], x[j]))
        K, j = K - 1, i
    return ends[::-1]


def segments(s: np.ndarray, d: np.ndarray, n: np.ndarray, step: np.ndarray, least_days: np.ndarray, kmax: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``windows.segment_windows`` of a batch of series (series, a, b); step, least length and number of chords of each series."""
    s, i, x, v = interpolant(s, d, n, step)
    f = np.append(starts([s]), len(s))
    who, ends = [], []
    for lo, hi in zip(f[:-1], f[1:], strict=True):
        k = s[lo]
        own = chords(x[lo:hi], v[lo:hi], max(2, int(round(least_days[k] / step[k]))), int(kmax[k]))
        who += [k] * len(own)
        ends += own
    a, b = np.array(ends, float).reshape(-1, 2).T
    return np.array(who, int), a, b


def units(take: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the groups ``take``: number within ``take`` and place of each."""
    m = size[take]
    g = np.repeat(np.arange(len(take)), m)
    return g, np.arange(len(g)) - np.repeat(np.cumsum(m) - m, m) + start[take][g]


def blocks(weight: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of about ``most`` of the weights' sum, each of one at least."""
    upto, at = np.cumsum(weight), 0
    while at < len(weight):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class Observed:
    """Observations of a batch of series, in the order of series and time; times that are no numbers only count in the totals."""

    def __init__(self, s: np.ndarray, d: np.ndarray, n: np.ndarray, count: int):
        n = np.nan_to_num(n)
        self.count, self.N = count, np.bincount(s, n, count)
        there = ~np.isnan(d)
        self.s, self.d, self.n = s[there], d[there], n[there]
        self.size = np.bincount(self.s, minlength=count)
        self.start = np.cumsum(self.size) - self.size
        self.days = Days(self.s, self.d, self.n, count)

    def windows(self, own: np.ndarray, o: dict[str, np.ndarray], more: np.ndarray | None = None) -> Iterator[tuple[slice, tuple[np.ndarray, ...]]]:
        """Acceptance windows of units, a block at a time with the units' slice: ``own`` is the series of each, ``o`` its options, ``more`` a weight besides its observations.
        Series are cut into segments once for all options of equal step, least length and number of chords."""
        cut = np.flatnonzero(o["strategy"] != "cluster")
        shape = np.stack([own[cut], o["grid_step_days"][cut], o["min_seg_days"][cut], o["kmax"][cut]], 1).astype(float)
        shape, place = np.unique(shape, axis=0, return_inverse=True)
        g, at = units(shape[:, 0].astype(int), self.start, self.size)
        sg, sa, sb = segments(g, self.d[at], self.n[at], shape[:, 1], shape[:, 2], shape[:, 3])
        many = np.bincount(sg, minlength=len(shape))
        first = np.cumsum(many) - many
        for part in blocks((self.size + 1)[own] * (1 if more is None else more), BLOCK):
            mine = own[part]
            g, at = units(mine, self.start, self.size)
            here = slice(*np.searchsorted(cut, (part.start, part.stop)))
            cg, ca = units(place.reshape(-1)[here], first, many)
            cuts = cut[here][cg] - part.start, sa[ca], sb[ca]
            found = acceptance(mine, g, self.d[at], self.days, self.N[mine], {k: v[part] for k, v in o.items()}, cuts)
            yield part, found


    def slots(self, here: Tested) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of observed times before each event; of each series their number, the cumulative counts at them, and where these begin."""
        at = starts([self.s, self.d]) if len(self.s) else np.zeros(0, int)
        s, d = self.s[at], self.d[at]
        marks = np.bincount(s, minlength=self.count)
        after = np.cumsum(marks) - marks
        total = np.cumsum(np.add.reduceat(self.n, at)) if len(at) else np.zeros(0)
        upto = total - np.append(0.0, total)[after][s]
        every = np.unique(d)
        key = s * (len(every) + 1) + np.searchsorted(every, d)
        return np.searchsorted(key, here.s * (len(every) + 1) + np.searchsorted(every, here.t, "left")) - after[here.s], marks, upto, after


class Tested:
    """Trajectories of a batch of series with their events, in the order of series, trajectory and time."""

    def __init__(self, s: np.ndarray, traj: np.ndarray, t: np.ndarray, count: int):
        q = starts([s, traj])
        self.many = np.bincount(s[q], minlength=count)
        self.first = np.cumsum(self.many) - self.many
        own = np.repeat(np.arange(len(q)), np.diff(np.append(q, len(s))))
        there = ~np.isnan(t)
        self.q, self.t, self.s = own[there], t[there], s[there]
        self.all = np.unique(self.t)
        self.width = len(self.all) + 1
        self.key = self.q * self.width + np.searchsorted(self.all, self.t)
        self.size = np.bincount(self.q, minlength=len(q))
        self.start = np.cumsum(self.size) - self.size

    def accepted(self, own: np.ndarray, win: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (unit, trajectory) with all counts within the bounds of the unit's windows."""
        g, a, b, L, U = win
        unit, traj = units(own, self.first, self.many)
        at = np.cumsum(self.many[own]) - self.many[own]
        ok = np.isin(unit, g)
        lo, hi = np.searchsorted(self.all, a, "left"), np.searchsorted(self.all, b, "right")
        for part in blocks(self.many[own[g]], BLOCK):
            w, q = units(own[g[part]], self.first, self.many)
            base = q * self.width
            n = np.searchsorted(self.key, base + hi[part][w]) - np.searchsorted(self.key, base + lo[part][w])
            bad = np.flatnonzero((n < L[part][w]) | (n > U[part][w]))
            w, q = w[bad], q[bad]
            ok[at[g[part]][w] + q - self.first[own[g[part]]][w]] = False
        return unit[ok], traj[ok]
