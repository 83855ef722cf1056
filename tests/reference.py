"""Brute-force versions of the distribution operators, for small samples."""

import numpy as np
import pandas as pd


def wasserstein(a, b, p=2, wa=None, wb=None):
    """Integral of |Qa - Qb|^p over the merged steps of both distribution functions."""

    def steps(x, w):
        order = np.argsort(x, kind="stable")
        w = np.ones(len(x)) if w is None else np.asarray(w, float)
        return np.asarray(x, float)[order], np.cumsum(w[order]) / w.sum()

    (xa, ua), (xb, ub) = steps(a, wa), steps(b, wb)
    u = np.unique(np.concatenate([[0.0], ua, ub]))
    middle = (u[1:] + u[:-1]) / 2
    qa = xa[np.minimum(np.searchsorted(ua, middle), len(xa) - 1)]
    qb = xb[np.minimum(np.searchsorted(ub, middle), len(xb) - 1)]
    return float((np.diff(u) * np.abs(qa - qb) ** p).sum() ** (1 / p))


def ecdf(x):
    return np.searchsorted(np.sort(x), x, side="right") / len(x)


def quantile_map(source, target):
    return np.quantile(target, np.clip(ecdf(source), 0.001, 0.999))


def weighted_quantile_map(source, ws, target, wt):
    def knots(x, w):
        sums = pd.DataFrame({"x": x, "w": w}).groupby("x").w.sum()
        return sums.index.to_numpy(), sums.cumsum().to_numpy() / sums.sum()

    x, share = knots(source, ws)
    share = share.copy()
    share[0] /= 2
    rank = np.clip(share[np.searchsorted(x, source)], 0.001, 0.999)
    y, e = knots(target, wt)
    return np.interp(rank, np.r_[0, e], np.r_[y[0], y])


def mixed_sample(n=2500, seed=0, hot=0.3):
    """Cells and groups of unequal size; one value holds a large part of all rows."""
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "cell": rng.choice(["x", "y", None], n, p=[0.7, 0.2, 0.1]),
            "g": rng.choice(["a", "b", "ref"], n, p=[0.2, 0.3, 0.5]),
            "v": np.where(rng.random(n) < hot, 5.0, np.round(rng.normal(5, 1, n), 2)),
            "wt": rng.integers(1, 5, n),
        }
    )
    return frame
