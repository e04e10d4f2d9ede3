"""Many penalised logistic fits at once.

All fits share the rows and differ in weights, labels, ridges and bounds. A round is one pass: every task sums, for each fit, the loss, the gradient
and the Gram matrix at the fit's present coefficients, and one grouped sum by (fit, place) adds the tasks' sums. What reaches the driver is fits x
columns^2 numbers, whatever the rows. There a Newton step is taken on each fit: the quadratic model is minimised within the bounds by an active
set, and a step that makes the loss larger is halved in the next pass. Columns that are constant, or zero on all rows a fit sees, keep a
curvature by their ridge, so they need no special case; a fit without weight keeps zeros.
"""
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tocsin.operators.lineage import stable

ROUNDS, TOLERANCE, FARTHEST = 25, 1e-8, 30.0


@dataclass(frozen=True)
class Fit:
    """Ridge by column for the columns that are free and those that must not be negative; the rows' weights and labels. The intercept is free
    and has no ridge."""
    name: str
    free: dict[str, float]
    positive: dict[str, float]
    weight: Column = field(default_factory=lambda: F.lit(1.0))
    label: Column = field(default_factory=lambda: F.col("y"))


@dataclass
class Solution:
    """Coefficients by column and `intercept`, the projected gradient's largest entry per unit of weight, the total weight, and the passes."""
    theta: dict[str, float]
    gradient: float
    weight: float
    rounds: int


def box_step(gradient: np.ndarray, gram: np.ndarray, at: np.ndarray, bounded: np.ndarray) -> np.ndarray:
    """The d that minimises gradient.d + d.gram.d / 2 with at + d >= 0 where bounded."""
    held = bounded & (at <= 0) & (gradient > 0)
    d = np.zeros(len(at))
    for _ in range(4 * len(at)):
        d[held] = -at[held]
        go = ~held
        d[go] = np.linalg.solve(gram[np.ix_(go, go)], -(gradient[go] + gram[np.ix_(go, held)] @ d[held]))
        below = go & bounded & (at + d < -1e-12)
        if below.any():
            held |= below
            continue
        push = gradient + gram @ d
        loose = held & (push < -1e-9 * (1 + np.abs(gradient).max()))
        if not loose.any():
            return d
        held[np.argmin(np.where(loose, push, np.inf))] = False
    return d


def _sums(rows: DataFrame, thetas: np.ndarray, live: np.ndarray, one_label: bool) -> np.ndarray:
    """fits x (weight, loss, gradient, upper half of the Gram matrix), summed over the rows."""
    fits, p = thetas.shape
    upper = np.triu_indices(p)

    def run(batches):
        total = np.zeros((fits, 2 + p + len(upper[0])))
        for batch in batches:
            n = batch.num_rows
            take = lambda i, k: np.asarray(batch.column(i).flatten()).reshape(n, k)
            x, w, y = take(0, p), take(1, fits), take(2, 1 if one_label else fits)
            for k in np.flatnonzero(live):
                on = w[:, k] > 0
                if not on.any():
                    continue
                a, wt, yy = x[on], w[on, k], y[on, 0 if one_label else k]
                z = a @ thetas[k]
                q = 1 / (1 + np.exp(-np.clip(z, -FARTHEST, FARTHEST)))
                total[k, 0] += wt.sum()
                total[k, 1] += (wt * (np.logaddexp(0, z) - yy * z)).sum()
                total[k, 2:2 + p] += a.T @ (wt * (q - yy))
                total[k, 2 + p:] += (a.T @ (a * (wt * q * (1 - q))[:, None]))[upper]
        k, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[k, slot])], ["fit", "slot", "v"])
    got = rows.mapInArrow(run, "fit int, slot int, v double").groupBy("fit", "slot").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((fits, 2 + p + len(upper[0])))
    out[got["fit"], got["slot"]] = got["v"]
    return out


def solve(rows: DataFrame, fits: Sequence[Fit], rounds: int = ROUNDS) -> dict[str, Solution]:
    """The minimum of every fit: weighted log loss plus half the ridge times the squared coefficient, over all rows with a weight above 0.

    Null values of columns, weights and labels count as 0. A column that a fit doesn't name is no part of it."""
    columns = list(dict.fromkeys(c for f in fits for c in [*f.free, *f.positive]))
    p, upper = len(columns) + 1, np.triu_indices(len(columns) + 1)
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    one_label = len({str(f.label) for f in fits}) == 1
    labels = [fits[0].label] if one_label else [f.label for f in fits]
    x = stable(rows.select(F.array(F.lit(1.0), *[number(F.col(f"`{c}`")) for c in columns]).alias("x"), F.array(*[number(f.weight) for f in fits]).alias("w"),
                           F.array(*[number(c) for c in labels]).alias("y")).where(F.exists("w", lambda v: v > 0)))
    place = {c: i + 1 for i, c in enumerate(columns)}
    used, bounded, ridge = np.zeros((len(fits), p), bool), np.zeros((len(fits), p), bool), np.zeros((len(fits), p))
    used[:, 0] = True
    for k, f in enumerate(fits):
        for c, r in [*f.free.items(), *f.positive.items()]:
            used[k, place[c]], ridge[k, place[c]] = True, r
        bounded[k, [place[c] for c in f.positive]] = True
    theta = np.zeros((len(fits), p))
    best, step, share = [None] * len(fits), np.zeros((len(fits), p)), np.ones(len(fits))
    open_, norm, passes, weight = np.ones(len(fits), bool), np.zeros(len(fits)), np.zeros(len(fits), int), np.zeros(len(fits))
    for n in range(rounds):
        s = _sums(x, theta.copy(), open_.copy(), one_label)
        for k in np.flatnonzero(open_):
            passes[k], weight[k] = n + 1, s[k, 0]
            loss = s[k, 1] + 0.5 * (ridge[k] * theta[k] ** 2).sum()
            if s[k, 0] <= 0:
                open_[k] = False
                continue
            if best[k] is not None and loss > best[k][0] + 1e-12 * abs(best[k][0]) and share[k] > 1e-6:
                share[k] /= 2                                    # too far: half the way from the last good place
                theta[k] = best[k][1] + share[k] * step[k]
                continue
            gradient = s[k, 2:2 + p] + ridge[k] * theta[k]
            gram = np.zeros((p, p))
            gram[upper] = s[k, 2 + p:]
            gram = gram + np.triu(gram, 1).T + np.diag(ridge[k])
            gram[0, 0] += 1e-12 * s[k, 0] + 1e-300
            best[k], share[k], u = (loss, theta[k].copy()), 1.0, used[k]
            norm[k] = np.abs(np.where(bounded[k][u] & (theta[k][u] <= 0), np.minimum(gradient[u], 0), gradient[u])).max() / s[k, 0]
            at_end = abs(theta[k, 0]) >= FARTHEST                # no row of one of the two labels
            if norm[k] <= TOLERANCE or at_end:
                open_[k] = False
                continue
            step[k] = 0.0
            step[k, u] = box_step(gradient[u], gram[np.ix_(u, u)], theta[k][u], bounded[k][u])
            step[k, 0] = np.clip(theta[k, 0] + np.clip(step[k, 0], -5, 5), -FARTHEST, FARTHEST) - theta[k, 0]
            theta[k] = theta[k] + step[k]
            theta[k, bounded[k]] = np.maximum(theta[k, bounded[k]], 0)
        if not open_.any():
            break
    return {f.name: Solution({"intercept": float(theta[k, 0]), **{c: float(theta[k, place[c]]) for c in [*f.free, *f.positive]}}, float(norm[k]), float(weight[k]),
                             int(passes[k])) for k, f in enumerate(fits)}
