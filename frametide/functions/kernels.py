"""Numeric kernels for one recording's series, in numpy."""

from __future__ import annotations

import math

import numpy as np


_BLOCK = 1 << 22  # numbers that a kernel holds at once for pairs of points


def _nearest_spans(x: np.ndarray, k: int) -> np.ndarray:
    """For ascending x, where each point's k nearest ones begin: they are neighbours in order."""
    n = len(x)
    start = np.zeros(n, np.int64)
    lo, hi = np.maximum(0, np.arange(n) - k + 1), np.minimum(np.arange(n), n - k)
    while (lo < hi).any():  # the first start from which moving on would lose more than it gains
        middle = (lo + hi) // 2
        on = x - x[middle] > x[np.minimum(middle + k, n - 1)] - x
        on &= middle + k < n
        lo, hi = np.where(on & (lo < hi), middle + 1, lo), np.where(~on & (lo < hi), middle, hi)
    start[:] = lo
    return start


def local_fits(x: np.ndarray, y: np.ndarray, trust: np.ndarray, at: np.ndarray, k: int, degree: int) -> np.ndarray:
    """For ascending x, the value at each of the places `at` of a polynomial fitted to its k nearest points, with tricube weights times
    their trust. The fits of a block of points are solved together from weighted sums. A point with too few neighbours of weight
    gets nan; one whose neighbours are at too few places has the shortest of fits."""
    start, span, rows = _nearest_spans(x, k), np.arange(k), max(1, _BLOCK // (k * (degree + 1)))
    out = np.empty(len(at))
    for lo in range(0, len(at), rows):
        own = at[lo : lo + rows]
        near = start[own][:, None] + span
        away = x[near] - x[own][:, None]
        width = np.abs(away).max(1)[:, None]
        w = np.where(width > 0, np.clip(1 - (np.abs(away) / np.where(width > 0, width, 1)) ** 3, 0, 1) ** 3, away == 0) * trust[near]
        z = away / np.where(width > 0, width, 1)
        powers = [w * z**p for p in range(2 * degree + 1)]
        sums = np.stack([p.sum(1) for p in powers])
        right = np.stack([(powers[p] * y[near]).sum(1) for p in range(degree + 1)], 1)
        left = np.stack([[sums[p + q] for q in range(degree + 1)] for p in range(degree + 1)]).transpose(2, 0, 1)
        enough = (w > 0).sum(1) > degree
        poor = enough & (np.linalg.cond(left) >= 1e12)
        fit = np.linalg.solve(np.where((enough & ~poor)[:, None, None], left, np.eye(degree + 1)), right[:, :, None])[:, 0, 0]
        if poor.any():
            fit[poor] = (np.linalg.pinv(left[poor]) @ right[poor][:, :, None])[:, 0, 0]
        out[lo : lo + rows] = np.where(enough, fit, np.nan)
    return out


def neighbours_of(n: int, fraction: float, degree: int) -> int:
    return min(n, max(degree + 1, math.ceil(fraction * n)))


def loess(x: np.ndarray, y: np.ndarray, fraction: float = 0.5, degree: int = 1, robust: int = 2) -> np.ndarray:
    """Cleveland's locally weighted regression: tricube weights over the nearest share of points, then bisquare reweighting. A point
    with too few neighbours of weight keeps its value."""
    n = len(x)
    k = neighbours_of(n, fraction, degree)
    if n <= degree + 1:
        return y.astype(float).copy()
    order = np.argsort(x, kind="stable")
    x, y = x[order].astype(float), y[order].astype(float)
    out, trust = y.copy(), np.ones(n)
    for _ in range(robust + 1):
        fit = local_fits(x, y, trust, np.arange(n), k, degree)
        out = np.where(np.isnan(fit), out, fit)
        residual = np.abs(y - out)
        scale = 6 * np.median(residual)
        if scale <= 1e-12 * (np.abs(y).max() + 1e-300):
            break
        trust = np.clip(1 - (residual / scale) ** 2, 0, 1) ** 2
    back = np.empty(n)
    back[order] = out
    return back


def _usual_depth(n: float) -> float:
    """The mean depth of an unsuccessful search in a random binary tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def isolation_forest(x: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 0, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(score, is it an inlier): points that random splits part soon score above 1/2 and are outliers. Trees grow on samples of the
    first `among` points, of all if it is not given."""
    n, width = x.shape
    among = n if among is None else among
    if among < 2:
        return np.zeros(n), np.ones(n, bool)
    rng = np.random.default_rng(seed)
    size = min(subsample, among)
    limit = math.ceil(math.log2(max(2, size)))
    # All trees grow at once, a level at a time, from the first `among` points alone. A node is a number; `where` says in which node of
    # each tree a point is. What is known of a node is kept by node, so a level costs a point three lookups.
    drawn = rng.random((trees, among))
    drawn = (np.argpartition(drawn, size - 1, axis=1) if size < among else np.tile(np.arange(among), (trees, 1)))[:, :size]
    own_row = (np.arange(trees)[:, None] * among + drawn).ravel()
    columns = [np.ascontiguousarray(x[:among, c]) for c in range(width)]
    values, flat = [c.take(drawn.ravel()) for c in columns], np.concatenate(columns)
    point, usual_depths = np.tile(np.arange(among), trees), np.array([_usual_depth(c) for c in range(size + 1)])
    where, ended, levels = np.repeat(np.arange(trees), among), np.full(trees, np.nan), []
    most = trees
    for level in range(limit + 1):
        there = np.zeros(most, bool)
        there[where] = True
        nodes = np.flatnonzero(there)
        rank = np.cumsum(there) - 1
        at = rank.take(where)
        own = at.take(own_row)
        count = np.bincount(own, minlength=len(nodes))
        low, high = np.full((width, len(nodes)), np.inf), np.full((width, len(nodes)), -np.inf)
        for c in range(width):
            np.minimum.at(low[c], own, values[c])
            np.maximum.at(high[c], own, values[c])
        low, high = low.T, high.T
        split = (count > 1) & (high > low).any(1) & (level < limit)
        # a node below a leaf keeps the leaf's depth
        ended = ended[nodes // 2 if level else nodes]
        ended = np.where(np.isnan(ended) & ~split, level + usual_depths[count], ended)
        if not np.isnan(ended).any():
            levels.append((there, rank, None, None, ended))
            break
        feature = np.where(high > low, rng.random(low.shape), -1.0).argmax(1)
        k = np.arange(len(nodes))
        with np.errstate(invalid="ignore"):
            cut = low[k, feature] + rng.random(len(nodes)) * (high[k, feature] - low[k, feature])
        levels.append((there, rank, feature, cut, ended))
        right = flat.take((feature * among).take(at) + point) >= cut.take(at)
        where, most = at * 2 + right, 2 * len(nodes)
    depth = ended[at].reshape(trees, among).mean(0)
    if n > among:
        depth = np.concatenate([depth, _depths(x[among:], trees, levels)])
    score = 2.0 ** (-depth / _usual_depth(size))
    return score, score <= 0.5


def _depths(x: np.ndarray, trees: int, levels: list[tuple]) -> np.ndarray:
    """The mean depth of points that no tree grew on: each goes down to a leaf and stays there."""
    depth = np.full((trees, len(x)), np.nan)
    tree, point = (v.ravel() for v in np.indices(depth.shape))
    where = tree
    for level, (there, rank, feature, cut, ended) in enumerate(levels):
        known = there[where]  # a side that no point of the sample took is an empty leaf
        depth[tree[~known], point[~known]] = level
        tree, point, at = tree[known], point[known], rank[where[known]]
        stays = ~np.isnan(ended[at])
        depth[tree[stays], point[stays]] = ended[at[stays]]
        tree, point, at = tree[~stays], point[~stays], at[~stays]
        if not len(at):
            break
        where = at * 2 + (x[point, feature[at]] >= cut[at])
    return depth.mean(0)


def local_outlier_factor(x: np.ndarray, ids: np.ndarray, neighbours: int) -> np.ndarray:
    """How much sparser each point lies than its neighbours do; of points at one distance those with smaller ids come first. For rows in
    ascending order of ids; rows of one id are no neighbours of each other and get the factor of the first of them."""
    first = np.flatnonzero(np.diff(ids, prepend=-1)) if len(ids) else np.empty(0, np.int64)
    back = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    if len(first) < 2:
        return np.ones(len(ids))
    k = min(neighbours, len(ids) - 1)
    near, away = np.empty((len(first), k), np.int64), np.empty((len(first), k))
    step = max(1, _BLOCK // (len(x) * x.shape[1]))
    for lo in range(0, len(first), step):
        own = first[lo : lo + step]
        far = ((x[own, None] - x[None]) ** 2).sum(2)
        far[back[own, None] == back[None]] = np.inf
        near[lo : lo + step] = np.argsort(far, axis=1, kind="stable")[:, :k]
        away[lo : lo + step] = np.sqrt(np.take_along_axis(far, near[lo : lo + step], 1))
    found = np.isfinite(away)  # fewer where ids are shared
    near, count = back[near], found.sum(1)
    radius = np.where(found, away, 0.0).max(1)
    density = 1 / (np.where(found, np.maximum(away, radius[near]), 0.0).sum(1) / count + 1e-10)
    return (np.where(found, density[near], 0.0).sum(1) / count / density)[back]


def support_vector(x: np.ndarray, y: np.ndarray, c: float = 0.9, epsilon: float = 0.1, steps: int = 300) -> np.ndarray:
    """Fitted values of an epsilon-insensitive regression with a radial kernel of width 1 / variance, by coordinate descent."""
    n = len(x)
    if not n:
        return y.astype(float)
    spread = x.var()
    gamma = 1 / spread if spread > 0 else 1.0
    beta, fit = np.zeros(n), np.zeros(n)
    for _ in range(steps):
        moved = 0.0
        for i in range(n):
            gap = y[i] - fit[i] + 2.0 * beta[i]  # the kernel of a point with itself is 1, + 1: the intercept
            new = np.clip(np.sign(gap) * max(0.0, abs(gap) - epsilon) / 2.0, -c, c)
            if new != beta[i]:
                fit += (new - beta[i]) * (np.exp(-((x - x[i]) ** 2) * gamma) + 1.0)  # one column, not the whole matrix
                moved = max(moved, abs(new - beta[i]))
                beta[i] = new
        if moved < 1e-6 * c:
            break
    return fit


def support_vectors(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, c: float = 0.9, epsilon: float = 0.1, steps: int = 300) -> np.ndarray:
    """support_vector() of each of the series between the bounds, with the same sums. Series of like length go down their coordinates side
    by side, with all their kernels at hand; a series whose kernel is larger than a block is fitted by itself."""
    out, sizes = np.empty(len(y)), np.diff(bounds)
    order = np.argsort(sizes, kind="stable")[::-1]
    order, at = order[sizes[order] > 0], 0
    while at < len(order):
        n = int(sizes[order[at]])
        if n * n > _BLOCK:
            lo, hi = bounds[order[at]], bounds[order[at] + 1]
            out[lo:hi], at = support_vector(x[lo:hi], y[lo:hi], c, epsilon, steps), at + 1
            continue
        alike = int(np.searchsorted(-sizes[order], -0.8 * n, side="right"))  # shorter ones would be mostly padding
        some = order[at : min(alike, at + max(1, _BLOCK // (n * n)))]
        at += len(some)
        m = len(some)
        xs, ys, gamma, own = np.zeros((m, n)), np.zeros((m, n)), np.ones(m), np.zeros((m, n), bool)
        for k, s in enumerate(some.tolist()):
            lo, hi = bounds[s], bounds[s + 1]
            xs[k, : hi - lo], ys[k, : hi - lo], own[k, : hi - lo] = x[lo:hi], y[lo:hi], True
            spread = x[lo:hi].var()
            gamma[k] = 1 / spread if spread > 0 else 1.0
        # a coordinate's columns for all series lie side by side
        kernel = np.exp(-((xs.T[:, :, None] - xs[None, :, :]) ** 2) * gamma[None, :, None])
        kernel += 1.0
        which, beta, fit, fitted = np.arange(m), np.zeros((n, m)), np.zeros((m, n)), np.zeros((m, n))
        left, target, ended = np.ascontiguousarray(own.T), np.ascontiguousarray(ys.T), np.zeros(m, bool)
        for _ in range(steps):
            moved = np.zeros(len(which))
            for i in range(n):
                gap = target[i] - fit[:, i] + 2.0 * beta[i]
                new = np.minimum(np.maximum(np.sign(gap) * np.maximum(0.0, np.abs(gap) - epsilon) / 2.0, -c), c)
                step = (new - beta[i]) * left[i]
                going = np.flatnonzero(step)
                if len(going) * 2 > len(step):
                    fit += step[:, None] * kernel[i]
                elif len(going):
                    fit[going] += step[going, None] * kernel[i, going]
                np.maximum(moved, np.abs(step), out=moved)
                beta[i] = np.where(left[i], new, 0.0)
            done = (moved < 1e-6 * c) & ~ended
            if done.any():  # these stay as they are
                fitted[which[done]] = fit[done]
                left[:, done], ended = False, ended | done
                if ended.all():
                    break
                if ended.mean() > 0.25:
                    on = np.flatnonzero(~ended)
                    which, fit, beta, target, left, kernel, ended = which[on], fit[on], beta[:, on], target[:, on], left[:, on], kernel[:, on], ended[on]
        fitted[which[~ended]] = fit[~ended]
        for k, s in enumerate(some.tolist()):
            out[bounds[s] : bounds[s + 1]] = fitted[k, : sizes[s]]
    return out
