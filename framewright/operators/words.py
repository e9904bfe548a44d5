"""Likeness of two words: time warping whose result is weighed by how much the frames change, and warping along a third axis.

Both work on whole Arrow batches, cell by cell: what the result needs of the best path is carried along
with its cost, so no path is kept or walked back.  Costs above `clip` count as `FAR`: frames that
unlike each other are never passed for free, only at a price that no other path has.

Empty against empty is 0; against another, and where no path fits, the result is null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.operators.align import cosine_costs

FAR = 1e6
#: Pairs of like size that are warped together.
TOGETHER = 256


def clipped(costs: np.ndarray, clip: float) -> np.ndarray:
    return np.where(costs > clip, FAR, costs)


def best_of(straight: np.ndarray, along: np.ndarray, down: np.ndarray) -> np.ndarray:
    """0, 1 or 2: which of the ways is cheapest; of equals straight, then along."""
    return np.where((straight <= along) & (straight <= down), 0, np.where(along <= down, 1, 2))


def changes(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """How much each frame changes: the length of its columns first..last-1 (differences, where frames carry them)."""
    return np.sqrt((x[:, first:last] ** 2).sum(1))


def change_weighted(costs: np.ndarray, fx: np.ndarray, fy: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For cost matrices (pair, i, j) and the frames' changes (pair, i), (pair, j): the mean cost along each pair's best path, its cells
    weighed by the length of both frames' changes, times the path's length over n + m.  Without any change all cells weigh the same."""
    pairs, rows, columns = costs.shape
    # total, weighed cost, weight, plain cost, cells - of the best path to each cell of the row above and of this row
    above = np.zeros((5, pairs, columns + 1))
    above[0, :, 1:] = np.inf
    out = np.full(pairs, np.nan)
    for i in range(rows):
        here = np.zeros((5, pairs, columns + 1))
        here[0, :, 0] = np.inf
        for j in range(columns):
            ways = np.stack((above[:, :, j], here[:, :, j], above[:, :, j + 1]))
            came = best_of(*ways[:, 0])
            before = ways[came, :, np.arange(pairs)].T
            cost, weight = costs[:, i, j], np.hypot(fx[:, i], fy[:, j])
            here[:, :, j + 1] = before + np.stack((cost, cost * weight, weight, cost, np.ones(pairs)))
        done = n == i + 1
        if done.any():
            k = np.flatnonzero(done)
            _, weighed, weight, plain, cells = here[:, k, m[k]]
            mean = np.where(weight > 0, weighed / np.where(weight > 0, weight, 1), plain / cells)
            out[k] = mean * cells / (n[k] + m[k])
        above = here
    return out


def third_axis(costs: np.ndarray, flux: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least cost of paths through (k, i, j) from (0, 0, 0) to (len(flux) - 1, n - 1, m - 1), a cell costing flux[k] times its pair's cost.

    A step moves on in i, in j or in both, and may take k along; k never moves alone.  The cost is divided by half the
    depth and by the entropy of where the path met flux (before or after the middle of i), so flux on one side only counts as worse."""
    pairs, rows, columns = costs.shape
    depth = len(flux)
    half = (n // 2)[:, None]
    total = np.full((pairs, depth, rows, columns), np.inf)
    early, late = np.zeros_like(total), np.zeros_like(total)

    def way(i: int, j: int) -> np.ndarray:
        """Cost, early and late flux (with the cell's own) of the paths to (k, i, j), for every k."""
        if i < 0 or j < 0:
            return np.stack((np.full((pairs, depth), np.inf), np.zeros((pairs, depth)), np.zeros((pairs, depth))))
        after = i > half
        return np.stack((total[:, :, i, j], early[:, :, i, j] + np.where(after, 0, flux), late[:, :, i, j] + np.where(after, flux, 0)))

    def chosen(ways: np.ndarray) -> np.ndarray:
        came = best_of(*ways[:, 0])
        return np.take_along_axis(ways, came[None, None], 0)[0]

    for i in range(rows):
        for j in range(columns):
            if not i and not j:
                total[:, 0, 0, 0] = flux[0] * costs[:, 0, 0]
                continue
            same = chosen(np.stack((way(i - 1, j - 1), way(i, j - 1), way(i - 1, j))))
            deeper = np.concatenate((np.stack((np.full((pairs, 1), np.inf), np.zeros((pairs, 1)), np.zeros((pairs, 1)))), same[:, :, :-1]), axis=2)
            got = np.where(deeper[0] <= same[0], deeper, same)
            total[:, :, i, j] = got[0] + flux * costs[:, i, j, None]
            if i and j:  # the walk back ends where one of the three axes does
                early[:, 1:, i, j], late[:, 1:, i, j] = got[1][:, 1:], got[2][:, 1:]
    k = np.arange(pairs)
    cost, a, b = (x[k, depth - 1, n - 1, m - 1] for x in (total, early, late))
    p = (a + 1e-3) / (a + b + 2e-3)
    entropy = -p * np.log2(p) - (1 - p) * np.log2(1 - p)
    return np.where(np.isfinite(cost), cost / max(1, (depth - 1) // 2) / entropy, np.nan)


def flux_pattern(depth: int, every: int = 5) -> np.ndarray:
    """1 at every fifth place of the third axis, 0 between."""
    return ((np.arange(depth) + 1) % every == 0).astype(np.float64)


def over_pairs(a: pd.Series, b: pd.Series, warp: Callable[[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]) -> pd.Series:
    """warp of all pairs of a batch, pairs of like size together, so little is filled up."""
    n, m = a.map(len).to_numpy(np.int64), b.map(len).to_numpy(np.int64)
    out = np.where((n == 0) & (m == 0), 0.0, np.nan)
    there = np.flatnonzero((n > 0) & (m > 0))
    for k in np.array_split(there[np.argsort(n[there] * m[there], kind="stable")], max(1, -(-len(there) // TOGETHER))):
        if len(k):
            out[k] = warp([np.stack(a.iloc[i]).astype(np.float64) for i in k], [np.stack(b.iloc[i]).astype(np.float64) for i in k], n[k], m[k])
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def filled(arrays: list[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros((len(arrays), *shape))
    for k, x in enumerate(arrays):
        out[(k, *map(slice, x.shape))] = x
    return out


def change_distance(x: Column, y: Column, first: int, last: int, clip: float = 1.0) -> Column:
    """`change_weighted` of two columns of frames, (1 - cosine) / 2 the cost; changes are columns first..last-1."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def warp(p, q, n, m):
            costs = filled([clipped(cosine_costs(u, v), clip) for u, v in zip(p, q, strict=True)], (n.max(), m.max()))
            return change_weighted(costs, filled([changes(u, first, last) for u in p], (n.max(),)), filled([changes(v, first, last) for v in q], (m.max(),)), n, m)

        return over_pairs(a, b, warp)

    return run(x, y)


def flux_distance(x: Column, y: Column, depth: int, every: int = 5, clip: float = 1.0) -> Column:
    """`third_axis` of two columns of frames with flux at every fifth place of a depth."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def warp(p, q, n, m):
            return third_axis(filled([clipped(cosine_costs(u, v), clip) for u, v in zip(p, q, strict=True)], (n.max(), m.max())), flux_pattern(depth, every), n, m)

        return over_pairs(a, b, warp)

    return run(x, y)
