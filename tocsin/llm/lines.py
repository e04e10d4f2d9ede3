"""Quality of texts by a linear-chain conditional random field over their lines.

Every line with a word is a place of the chain, good or bad. Its evidence are binned features of itself and of the lines before and after; one weight
matrix joins neighbouring labels. Lines of a labelled text carry its label to fit. A text's raw quality is the mean of its lines'
marginals of being good, from the forward and backward pass, weighted by their length; a logistic curve fitted on
the training texts turns it into a score.

The field is fitted by gradient ascent on the driver, on at most about MOST_TEXTS labelled texts of at most MOST_LINES lines (documented
bounds; counts, features and scores cover all texts). Scoring runs in Arrow batches: features from byte arrays, chains of a batch side by side.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tocsin.llm.shared import Carried
from tocsin.llm.words import NOT_SPACE, slices, words

MOST_TEXTS, MOST_LINES = 3000, 400
SLICE = 1 << 20  # bytes of text whose words and lines are held at a time in a task; a longer text stands alone
BINS, STEPS, RATE, RIDGE = 8, 120, 0.3, 1e-3
NAMES = ["symbols", "upper", "digits", "bars", "marks", "other", "word_length", "short_words", "repeats", "length", "copied"]

# Byte groups of the features.
GROUPS = [b"#$%&*<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!", b".,;:'\"()?-"]
_IN = np.zeros((len(GROUPS), 256), bool)
for _k, _g in enumerate(GROUPS):
    _IN[_k, list(_g)] = True


@dataclass
class Lines:
    """Features of all lines with a word, their lengths, and the n + 1 bounds of each text's lines."""
    x: np.ndarray
    size: np.ndarray
    at: np.ndarray


def lines(t) -> Lines:
    w = words(t, NOT_SPACE, fold=False)
    cut = np.flatnonzero(t.data == 10)
    start = np.sort(np.concatenate([t.at[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([cut, t.at[1:]]), kind="stable")
    row = np.repeat(np.arange(len(t)), np.diff(np.searchsorted(cut, t.at)) + 1)
    first, past = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    real = past > first
    start, end, row, first, past = start[real], end[real], row[real], first[real], past[real]
    at = np.searchsorted(row, np.arange(len(t) + 1))
    if not len(start):
        return Lines(np.zeros((0, len(NAMES))), np.zeros(0), at)
    size, n = (end - start).astype(float), (past - first).astype(float)
    cols = []
    for k in range(len(GROUPS)):
        places = np.flatnonzero(_IN[k][t.data])
        cols.append((np.searchsorted(places, end) - np.searchsorted(places, start)) / size)
    length = (w.end - w.start).astype(float)
    total = np.concatenate([[0.0], np.cumsum(length)])
    small = np.concatenate([[0.0], np.cumsum(length <= 3)])
    of = np.repeat(np.arange(len(start)), past - first)
    key = w.hash ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    repeats = np.bincount(of[again], minlength=len(start)) / n
    # a line whose words were all seen, in sum, in a line of the same text before
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w.hash, dtype=np.uint64)])
    mark = (sums[past] - sums[first]) ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mark, kind="stable")
    copied = np.zeros(len(start))
    copied[order[1:]] = mark[order][1:] == mark[order][:-1]
    cols += [(total[past] - total[first]) / n, (small[past] - small[first]) / n, repeats, np.log1p(n), copied]
    return Lines(np.stack(cols, 1), size, at)


@dataclass
class Field:
    """Bin edges (features x BINS-1), weights of bins (3 x features x BINS: line before, line, line after), bias, label pairs, and the curve."""
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: np.ndarray
    curve: tuple[float, float]


def bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], x[:, k], "right") for k in range(x.shape[1])], 1) if len(x) else np.zeros(x.shape, np.int64)


def evidence(b: np.ndarray, at: np.ndarray, f: Field) -> np.ndarray:
    """For each line, how much its own and its neighbours' features speak for good."""
    each = np.arange(b.shape[1])
    own = [f.weights[k][each, b].sum(1) for k in range(3)]
    out = own[1] + f.bias
    inner = np.ones(len(b), bool)
    inner[at[:-1][at[:-1] < len(b)]] = False
    later = np.flatnonzero(inner)
    out[later] += own[0][later - 1]
    out[later - 1] += own[2][later]
    return out


def marginals(e: np.ndarray, at: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, the expected counts of label pairs, and the log partition sum, by the forward and backward pass; chains that are
    still running at a place are advanced together."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    begin, n = at[:-1][order], n[order]
    m = np.exp(pairs)
    local = np.stack([1 / (1 + np.exp(np.clip(e, -60, 60))), 1 / (1 + np.exp(-np.clip(e, -60, 60)))], 1)
    ahead, scale, back = np.zeros((len(e), 2)), np.ones(len(e)), np.ones((len(e), 2))
    live = int((n > 0).sum())
    for step in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -step, "left"))
        here = begin[:live] + step
        a = local[here] * (ahead[here - 1] @ m if step else 1.0)
        scale[here] = a.sum(1)
        ahead[here] = a / scale[here][:, None]
    expected = np.zeros((2, 2))
    for step in range(int(n[0]) - 1 if len(n) else 0, 0, -1):
        live = int(np.searchsorted(-n, -step, "left"))
        here = begin[:live] + step
        message = local[here] * back[here] / scale[here][:, None]
        back[here - 1] = message @ m.T
        expected += np.einsum("ni,nj->ij", ahead[here - 1], message) * m
    p = ahead * back
    good = p[:, 1] / np.maximum(p.sum(1), 1e-300)
    log_local = np.maximum(e, 0) + np.log1p(np.exp(-np.abs(e)))
    return good, expected, float(np.log(scale).sum() + log_local.sum())


def fit_field(x: Lines, label: np.ndarray) -> Field:
    """Gradient ascent (with momentum by root mean squares) on the conditional likelihood of the lines' labels."""
    edges = np.stack([np.quantile(x.x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) if len(x.x) else np.zeros(BINS - 1) for k in range(len(NAMES))])
    f = Field(edges, np.zeros((3, len(NAMES), BINS)), 0.0, np.zeros((2, 2)), (0.0, 1.0))
    if not len(x.x) or label.min() == label.max():
        rate = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
        return Field(edges, f.weights, 0.0, f.pairs, (float(np.log(rate / (1 - rate))), 0.0))
    b = bins(x.x, edges)
    n = np.diff(x.at)
    y = np.repeat(label, n).astype(float)
    inner = np.ones(len(b), bool)
    inner[x.at[:-1][x.at[:-1] < len(b)]] = False
    later = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[later - 1].astype(int), y[later].astype(int)), 1)
    each = np.arange(len(NAMES))
    theta = np.zeros(3 * len(NAMES) * BINS + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        f.weights, f.bias, f.pairs = theta[:-5].reshape(3, len(NAMES), BINS), theta[-5], theta[-4:].reshape(2, 2)
        good, expected, _ = marginals(evidence(b, x.at, f), x.at, f.pairs)
        left = y - good
        grad = np.zeros((3, len(NAMES), BINS))
        for k in each:
            grad[1, k] = np.bincount(b[:, k], left, minlength=BINS)
            grad[0, k] = np.bincount(b[later - 1, k], left[later], minlength=BINS)
            grad[2, k] = np.bincount(b[later, k], left[later - 1], minlength=BINS)
        g = np.concatenate([grad.ravel(), [left.sum()], (seen - expected).ravel()]) / len(b) - RIDGE * theta
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta + RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8) / np.sqrt(step)
    f.weights, f.bias, f.pairs = theta[:-5].reshape(3, len(NAMES), BINS).copy(), float(theta[-5]), theta[-4:].reshape(2, 2).copy()
    raw, a, c = raw_quality(x, f), 0.0, 1.0
    for _ in range(200):  # the curve: logistic regression on one number, by Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a + c * raw, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([(label - p).sum() - 1e-3 * a, ((label - p) * raw).sum() - 1e-3 * c])
        h = np.array([[w.sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), (w * raw * raw).sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, c = a + d[0], c + d[1]
        if abs(d).max() < 1e-8:
            break
    f.curve = (float(a), float(c))
    return f


def raw_quality(x: Lines, f: Field) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, as log odds; 0 for texts without lines."""
    good, _, _ = marginals(evidence(bins(x.x, f.edges), x.at, f), x.at, f.pairs)
    weight = np.concatenate([[0.0], np.cumsum(x.size)])
    mean = np.diff(np.concatenate([[0.0], np.cumsum(good * x.size)])[x.at]) / np.maximum(np.diff(weight[x.at]), 1e-9)
    mean = np.where(np.diff(x.at) > 0, np.clip(mean, 1e-4, 1 - 1e-4), 0.5)
    return np.log(mean / (1 - mean))


def probability(x: Lines, f: Field) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f.curve[0] + f.curve[1] * raw_quality(x, f), -30, 30)))


def held_out(fold: int = 0, of: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fold: int = 0, of: int = 5) -> Field:
    """Fits the field to docs (doc_id, text) with a label quality 0 or 1 outside the held-out fold. Texts without a label, null labels and null texts
    aren't used; of texts labelled more than once each label counts."""
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality").filter(~held_out(fold, of))
    part = min(1.0, MOST_TEXTS / max(known.count(), 1))
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    few = known.filter(place < part)

    def run(batches):
        for batch, t in slices(batches, most=SLICE):
            x = lines(t)
            use = [i for i in range(len(t)) if 0 < x.at[i + 1] - x.at[i] <= MOST_LINES]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(use, pa.int64())), pa.array([x.x[x.at[i]:x.at[i + 1]].ravel() for i in use], pa.list_(pa.float64())),
                 pa.array([x.size[x.at[i]:x.at[i + 1]] for i in use], pa.list_(pa.float64())), batch.column(2).take(pa.array(use, pa.int64()))],
                ["quality", "x", "size", "doc_id"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    # bounded: few holds about MOST_TEXTS rows of two columns
    got = docs.filter(place < part).join(F.broadcast(few), "doc_id").select("text", F.col("quality").cast("int").alias("quality"), "doc_id").mapInArrow(
        run, f"quality int, x array<double>, size array<double>, doc_id {kind}").toArrow().sort_by("doc_id")
    size = [np.array(s, float) for s in got.column("size").to_pylist()]
    x = Lines(np.concatenate([np.zeros((0, len(NAMES))), *[np.array(v, float).reshape(-1, len(NAMES)) for v in got.column("x").to_pylist()]]),
              np.concatenate([np.zeros(0), *size]), np.concatenate([[0], np.cumsum([len(s) for s in size], dtype=np.int64)]).astype(np.int64))
    return fit_field(x, got.column("quality").to_numpy().astype(float))


def probabilities(batches, f: Field, column: str):
    """Parts of the batches, each with the probabilities of its texts."""
    for batch, t in slices(batches, column, SLICE):
        yield batch, probability(lines(t), f)


def scored(docs: DataFrame, field: Field, columns: list[str], least: float | None = None) -> DataFrame:
    """The named columns of every row with score; with `least`, only rows that reach it, without the score.

    A null or empty text scores what the labels give on the whole; texts of any length are scored whole; repeated rows alike; an empty table
    gives no rows. Only the named columns and text are read, so other names can't clash."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    own = Carried(docs, columns)

    def run(batches):
        for batch, p in probabilities(batches, shared.value, "t"):
            if least is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], "score"])
            else:
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(p >= least))
    if least is None:
        return own.back(own.df.mapInArrow(run, f"{own.schema}, score double"), "score")
    return own.back(own.df.mapInArrow(run, own.schema))
