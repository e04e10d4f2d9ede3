"""Boosted trees on histograms, with columns in which the prediction never falls.

Values are cut into bins at quantiles once. A level of a tree is one pass: every task sums gradient, curvature and count by (node, column, bin),
one grouped sum adds the tasks' sums, and nodes x columns x bins numbers reach the driver, whatever the rows. A split in a rising column
must give its right side the larger value; the middle of both values then bounds everything below, so no later split can undo it.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tocsin.operators.lineage import stable

# Fixed values of the candidate model.
ROUNDS, DEPTH, LEAST, RATE, RIDGE = 150, 3, 300, 0.05, 1.0
BINS, KEEP_EVERY = 32, 25


@dataclass
class Tree:
    """Nodes in order of making: column (-1: a leaf), last bin that goes left, the left child (the right one follows it), and the value."""
    column: list
    bin: list
    left: list
    value: list

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        column, cut, left = np.array(self.column), np.array(self.bin), np.array(self.left)
        for _ in range(len(self.column)):
            inner = column[at] >= 0
            if not inner.any():
                break
            i, n = np.flatnonzero(inner), at[inner]
            at[i] = left[n] + (bins[i, column[n]] > cut[n])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    columns: list
    edges: list
    start: float
    trees: list

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1)

    def predict(self, rows: DataFrame, name="raw") -> DataFrame:
        """The rows with the probability; null columns count as 0."""
        def run(batches):
            for b in batches:
                x = np.asarray(b.column(b.num_columns - 1).flatten()).reshape(b.num_rows, len(self.columns))
                z = self.start + sum((t.values(self.bins(x)) for t in self.trees), np.zeros(len(x)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-z)))], [*b.schema.names[:-1], name])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.withColumn("_x", _array(self.columns)).mapInArrow(run, f"{schema}, `{name}` double")


def _array(columns):
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns])


def _sums(rows: DataFrame, pending: list, tree: Tree, open_: list, columns: int, bins: int) -> np.ndarray:
    """open nodes x columns x bins x (gradient, curvature, count)."""

    def run(batches):
        total = None
        for b in batches:
            n = b.num_rows
            x = np.asarray(b.column(0).flatten()).reshape(n, -1)
            y, s = b.column(1).to_numpy(), b.column(2).to_numpy()
            z = s + sum((t.values(x) for t in pending), np.zeros(n))
            p = 1 / (1 + np.exp(-z))
            node = tree.nodes(x)
            slot = np.full(len(tree.column), -1)
            slot[open_] = range(len(open_))
            on = slot[node] >= 0
            if total is None:
                total = np.zeros((len(open_), x.shape[1], bins, 3))
            for c in range(x.shape[1]):
                key = slot[node[on]] * bins + x[on, c]
                for k, v in enumerate((p - y, p * (1 - p), np.ones(n))):
                    total[:, c, :, k] += np.bincount(key, v[on], len(open_) * bins).reshape(-1, bins)
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "v"])
    got = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(len(open_) * columns * bins * 3)
    out[got["at"].to_numpy(np.int64)] = got["v"].to_numpy()
    return out.reshape(len(open_), columns, bins, 3)


def _split(hist: np.ndarray, rising: np.ndarray, low: float, high: float, least: int, ridge: float):
    """(gain, column, bin, left value, right value) of the best split of one node, or None. hist: columns x bins x 3."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist.sum(axis=1)[:, None]
    right = whole - left
    value = lambda s: np.clip(-s[..., 0] / (s[..., 1] + ridge), low, high)      # noqa: E731
    loss = lambda s, v: s[..., 0] * v + 0.5 * (s[..., 1] + ridge) * v * v       # noqa: E731
    a, b = value(left), value(right)
    gain = loss(whole, value(whole)) - loss(left, a) - loss(right, b)
    ok = (left[..., 2] >= least) & (right[..., 2] >= least) & (~rising[:, None] | (a <= b))
    gain = np.where(ok, gain, -np.inf)
    c, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return None if not gain[c, k] > 1e-12 else (float(gain[c, k]), int(c), int(k), float(a[c, k]), float(b[c, k]))


def fit(train: DataFrame, columns, rising, y="y", rounds=ROUNDS, depth=DEPTH, least=LEAST, rate=RATE, ridge=RIDGE, bins=BINS) -> Boosted:
    """Trees for the log-odds of y. rising: the columns in which the prediction must not fall. Null columns count as 0."""
    columns = list(columns)
    cuts = train.agg(*[F.percentile_approx(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), [i / bins for i in range(1, bins)], 10_000).alias(f"q{i}")
                       for i, c in enumerate(columns)], F.avg(F.col(y).cast("double")).alias("mean")).first()
    edges = [np.unique(np.array(cuts[f"q{i}"] or [], float)) for i in range(len(columns))]
    mean = min(max(cuts["mean"] or 0.0, 1e-6), 1 - 1e-6)
    model = Boosted(columns, edges, float(np.log(mean / (1 - mean))), [])

    def binned(batches):
        for b in batches:
            x = model.bins(np.asarray(b.column(0).flatten()).reshape(b.num_rows, len(columns))).astype(np.int64)
            at = np.arange(0, x.size + 1, len(columns)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel())), b.column(1), pa.array(np.full(len(x), model.start))], ["x", "y", "s"])
    rows = stable(train.select(_array(columns).alias("x"), F.col(y).cast("double").alias("y")).mapInArrow(binned, "x array<long>, y double, s double"))
    mono, pending = np.array([c in set(rising) for c in columns]), []
    for r in range(rounds):
        tree, open_, bound = Tree([-1], [0], [0], [0.0]), [0], {0: (-np.inf, np.inf)}
        for _ in range(depth):
            hist, next_ = _sums(rows, pending, tree, open_, len(columns), bins), []
            for i, node in enumerate(open_):
                best = _split(hist[i], mono, *bound[node], least, ridge)
                if best is None:
                    continue
                _, c, k, a, b = best
                tree.column[node], tree.bin[node], tree.left[node] = c, k, len(tree.column)
                low, high = bound[node]
                mid = (a + b) / 2
                for value, lo, hi in ((a, low, mid if mono[c] else high), (b, mid if mono[c] else low, high)):
                    bound[len(tree.column)] = (lo, hi)
                    next_.append(len(tree.column))
                    tree.column.append(-1), tree.bin.append(0), tree.left.append(0), tree.value.append(value)
            open_ = next_
            if not open_:
                break
        if len(tree.column) == 1:
            break                                                # no split is left that helps
        tree.value = [v * rate for v in tree.value]
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == KEEP_EVERY and r + 1 < rounds:
            done = list(pending)

            def carried(batches):
                for b in batches:
                    x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                    s = b.column(2).to_numpy() + sum(t.values(x) for t in done)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["x", "y", "s"])
            rows, pending = stable(rows.mapInArrow(carried, "x array<long>, y double, s double")), []
    return model
