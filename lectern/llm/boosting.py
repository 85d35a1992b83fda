"""Small gradient-boosted trees: fitted on the driver from a bounded table, applied as SQL expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _split(binned, g, h, rows, least: int):
    """Best (gain, feature, threshold) of a node, from the sums of each distinct value."""
    import numpy as np

    best = (1e-6, None, None)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f, (values, at) in enumerate(binned):
        held = at[rows]
        n = np.bincount(held, minlength=len(values))
        there = np.flatnonzero(n)
        if len(there) < 2:
            continue
        v, n = values[there], np.cumsum(n[there])[:-1]
        left_g, left_h = (np.cumsum(np.bincount(held, x[rows], len(values))[there])[:-1] for x in (g, h))
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
        gain[(n < least) | (len(rows) - n < least)] = -1
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    return best


def _grow(x, binned, g, h, rows, depth: int, least: int, rate: float):
    gain, f, t = _split(binned, g, h, rows, least) if depth else (0, None, None)
    if f is None:
        return float(-rate * g[rows].sum() / (h[rows].sum() + 1))
    low = x[rows, f] <= t
    return (f, t, *(_grow(x, binned, g, h, part, depth - 1, least, rate) for part in (rows[low], rows[~low])))


def _value(tree, x):
    import numpy as np

    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _value(low, x), _value(high, x))


def fit(x, y, trees: int = 40, depth: int = 3, least: int = 8, rate: float = 0.3) -> list:
    """Trees for the log-odds of y (0 or 1), by second-order boosting of the logistic loss."""
    import numpy as np

    score, out = np.zeros(len(y)), []
    binned = [np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, binned, p - y, p * (1 - p), np.arange(len(y)), depth, least, rate)
        out.append(tree)
        score += _value(tree, x)
    return out


def predict(trees: list, x):
    import numpy as np

    return 1 / (1 + np.exp(-sum(_value(t, x) for t in trees)))


def threshold(scores, y, precision: float) -> float:
    """Least score at and above which rows held out from fitting reach ``precision``; above 1 if none does."""
    import numpy as np

    order = np.argsort(-scores, kind="stable")
    right, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    ends = np.append(scores[order][1:] < scores[order][:-1], True)
    ok = np.flatnonzero((right / n >= precision) & ends)
    return float(scores[order][ok[-1]]) if len(ok) else 2.0


def expression(trees: list, features: list[Column]) -> Column:
    """The trees' probability as a column."""

    def node(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, t, low, high = tree
        return F.when(features[f] <= t, node(low)).otherwise(node(high))

    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, map(node, trees))))
