"""Scoring by Brown's class-based bigrams.

Words are counted over all training texts. Every word seen at least SEEN times is put into one of CLASSES classes, so their number grows with the
corpus. The LISTED most frequent of them start from an exchange clustering on the driver: each word in turn moves to the class that raises the
likelihood of the class bigrams most, until no sweep gains enough. Then sweeps over all words follow in the cluster (`spread`): one table, written
once, lists the words before and after each word; a sweep reads it without an exchange, sums each word's neighbours by their present classes, and
moves it to its best class under the class bigrams of the sweep's start. Words seen less often are
one more class, the tail, which also stands for unknown words, and the end of a text is one. A text's probability is the product, over its words
and its end, of P(class | class before) from smoothed class bigrams and P(word | class) from counts; in the tail, counts are discounted and
what that frees goes to unknown words as one type.

The counts of all words stay a distributed table. Words seen at least as often as a threshold (chosen from the histogram of counts, so that at most
HELD words pass) are sent to the tasks with their classes; the others ("far" words, where that threshold is above SEEN) keep their classes in a
distributed table, which is joined to their word pairs in each sweep and to the words of the scored texts. The driver sees the pairs of the LISTED
words as a square of (LISTED + 2) ** 2 sums at most, class bigrams, and the classes of held words.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tocsin.llm.shared import keep
from tocsin.llm.words import NOT_SPACE, signed, slices, words

LISTED, CLASSES = 1024, 48
HELD = 4_000_000          # words sent to the tasks at most (25 bytes each in the largest table; a sweep takes 2)
SWEEPS, LEAST_GAIN = 12, 1e-6
SEEN = 3                  # words seen less often are the tail
SPREAD, SPREAD_GAIN = 4, 1e-4  # sweeps over all words at most
KAPPA = 20.0              # weight of the class unigram in a class bigram
MERGE_AT = 1 << 19        # hashes gathered in a task before they are merged
PART, PART_BITS = 1 << 18, 8  # occurrences of a word for each part its neighbours are cut into, and bits of the number of a part
PARTS = 1 << PART_BITS
SLICE = 1 << 20           # bytes of text taken at a time
SHIFT = (2 * HELD + 4).bit_length()  # bits of a neighbour's number and side
MASK = (1 << SHIFT) - 1


def training(docs: DataFrame, fold: int, of: int):
    """True for rows that the model may learn from: all but the held-out fold of crc32(doc_id as text); a null id trains."""
    return ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """w (hash), c over all words of the rows; each task adds up its own words first."""
    def run(batches):
        held, counts = [], []

        def merged():
            w, at = np.unique(np.concatenate(held), return_inverse=True)
            return w, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        for _, t in slices(batches, most=SLICE):
            w, c = np.unique(words(t, NOT_SPACE).hash, return_counts=True)
            held.append(w)
            counts.append(c.astype(np.int64))
            if sum(map(len, held)) >= MERGE_AT:
                w, c = merged()
                held, counts = [w], [c]
                if len(w) >= MERGE_AT // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(c)], ["w", "c"])
                    held, counts = [], []
        if held:
            w, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(c)], ["w", "c"])
    return train.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, dict]:
    """Hashes (sorted) and counts of all words seen at least `least` times, where at most HELD words are; and sums over the table."""
    many = np.array([(r["c"], r["k"]) for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).toLocalIterator()], np.int64).reshape(-1, 2)
    many = many[np.argsort(-many[:, 0])]
    fits = np.cumsum(many[:, 1]) <= HELD
    least = int(many[fits, 0].min()) if fits.any() else (int(many[:, 0].max()) + 1 if len(many) else 1)
    got = counts.filter(F.col("c") >= least).toArrow()
    w, c = got.column("w").to_numpy().astype(np.int64).view(np.uint64), got.column("c").to_numpy().astype(np.int64)
    order = np.argsort(w)
    ones, twos = (int(many[many[:, 0] == k, 1].sum()) for k in (1, 2))
    return w[order], c[order], {"least": least, "tokens": int((many[:, 0] * many[:, 1]).sum()), "types": int(many[:, 1].sum()), "ones": ones, "twos": twos,
                               "tail_types": int(many[many[:, 0] < SEEN, 1].sum()), "tail_tokens": int(many[many[:, 0] < SEEN].prod(1).sum())}


def pair_counts(train: DataFrame, listed: np.ndarray) -> np.ndarray:
    """How often number b follows number a over all training texts: numbers of listed words, then the tail, then the end."""
    n = len(listed) + 2
    shared = train.sparkSession.sparkContext.broadcast(listed)

    def run(batches):
        total = np.zeros(n * n, np.int64)
        for _, t in slices(batches, most=SLICE):
            w = words(t, NOT_SPACE)
            now, then = _sequence(_number(shared.value, w.hash), w.at, n - 1)
            total += np.bincount(now * n + then, minlength=n * n)
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(total[got])], ["p", "c"])
    sums = train.select("text").mapInArrow(run, "p long, c long").groupBy("p").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(n * n, np.int64)
    out[sums.column("p").to_numpy()] = sums.column("c").to_numpy()
    return out.reshape(n, n)


def _number(listed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted list, its length for those not there."""
    if not len(listed):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
    return np.where(listed[at] == h, at, len(listed))


def _sequence(number: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers before and after each step of the texts: every text starts and closes with the end."""
    rows = len(at) - 1
    now = np.full(len(number) + rows, end, np.int64)
    places = np.arange(len(number)) + np.repeat(np.arange(rows), np.diff(at))
    then = now.copy()
    then[places] = number
    now[places + 1] = number
    return now, then


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each listed word (0..classes-1); the last two numbers of `pairs` keep classes of their own."""
    n = len(pairs) - 2
    size = pairs.sum(1)
    of = np.empty(n + 2, np.int64)
    of[np.argsort(-size[:n], kind="stable")] = np.arange(n) % classes  # the most frequent words start apart
    of[n:] = [classes, classes + 1]
    k = classes + 2
    g = np.zeros((k, k))
    np.add.at(g, (of[:, None].repeat(n + 2, 1), of[None, :].repeat(n + 2, 0)), pairs)

    def value():
        return _xlogx(g).sum() - _xlogx(g.sum(1)).sum() - _xlogx(g.sum(0)).sum()

    before = value()
    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(-size[:n], kind="stable"):
            out = np.bincount(of, pairs[w], minlength=k)
            inn = np.bincount(of, pairs[:, w], minlength=k)
            own, a = float(pairs[w, w]), of[w]
            out[a] -= own
            inn[a] -= own
            g[a] -= out
            g[:, a] -= inn
            g[a, a] -= own
            left, right = g.sum(1) + inn, g.sum(0) + out  # the word's neighbours keep their own sums
            gain = (_xlogx(g + out) - _xlogx(g)).sum(1) + (_xlogx(g + inn[:, None]) - _xlogx(g)).sum(0)
            d = np.diagonal(g)
            gain += _xlogx(d + out + inn + own) - _xlogx(d + out) - _xlogx(d + inn) + _xlogx(d)
            gain -= _xlogx(left + out.sum() + own) - _xlogx(left) + _xlogx(right + inn.sum() + own) - _xlogx(right)
            b = int(np.argmax(gain[:classes]))
            g[b] += out
            g[:, b] += inn
            g[b, b] += own
            of[w], moved = b, moved + (a != b)
        now = value()
        if not moved or now - before < LEAST_GAIN * abs(before):
            break
        before = now
    return of


OUT, IN, OWN = 0, CLASSES + 2, 2 * (CLASSES + 2)  # neighbour s of a word: the class after it, IN + the class before it, OWN for the word itself


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)


class _Neighbours:
    """Counts of (word, its class, neighbour) gathered from word pairs and merged before they leave the task; with by_class, of classes only."""

    def __init__(self, by_class: bool):
        self.by_class, self.keys, self.counts = by_class, [], []

    def add(self, a, b, ka, kb, c):
        if not len(a):
            return
        own = a == b
        # words may have numbers of 64 bits: those of this call are numbered again, and merged within it
        if self.by_class:
            rows = [(ka, ka, kb, c)]
        else:
            rows = [(a, ka, np.where(own, OWN, kb), c), (b[~own], kb[~own], IN + ka[~own], c[~own])]
        w, k, s, c = (np.concatenate(x) for x in zip(*rows))
        ids, at = np.unique(w, return_inverse=True)
        kind = np.zeros(len(ids), np.int64)
        kind[at] = k
        key, c = _merged([at * (OWN + 1) + s], [c])
        self.keys.append(np.stack([ids[key // (OWN + 1)], kind[key // (OWN + 1)], key % (OWN + 1)]))
        self.counts.append(c)

    def full(self) -> bool:
        return sum(map(len, self.counts)) >= 2 * MERGE_AT

    def merged(self):
        """All rows so far as one batch."""
        w, k, s = np.concatenate(self.keys, axis=1)
        c = np.concatenate(self.counts)
        order = np.lexsort((s, w))
        w, k, s, c = w[order], k[order], s[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (s[1:] != s[:-1])]))
        self.keys, self.counts = [np.stack([w[first], k[first], s[first]])], [np.add.reduceat(c, first)]
        return self.batch() if len(first) >= MERGE_AT else None

    def batch(self):
        (w, k, s), c = self.keys[0], self.counts[0]
        self.keys, self.counts = [], []
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(k), pa.array(s), pa.array(c)], ["w", "k", "s", "c"])

    def rest(self):
        if self.counts:
            out = self.merged()
            yield out if out is not None else self.batch()


ROWS = "w long, k long, s long, c long"
LISTS = "g long, near array<long>"


def _far_id(h: np.ndarray) -> np.ndarray:
    """Numbers below 0 of words that aren't held."""
    return -1 - (h >> np.uint64(1)).astype(np.int64)


def far_pairs(train: DataFrame, held: np.ndarray) -> DataFrame:
    """a, b, c: how often word b follows a where one of them isn't held; held words and the end (len(held) + 1) by their numbers."""
    shared = train.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        n = len(shared.value)
        for _, t in slices(batches, most=SLICE):
            w = words(t, NOT_SPACE)
            at = _number(shared.value, w.hash)
            a, b = _sequence(np.where(at < n, at, _far_id(w.hash)), w.at, n + 1)
            far = (a < 0) | (b < 0)
            if not far.any():
                continue
            pair, c = np.unique(np.stack([a[far], b[far]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(c.astype(np.int64))], ["a", "b", "c"])
    return train.select("text").mapInArrow(run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def _grouped(key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Rows g, near from distinct sorted keys g << SHIFT | o with counts: one list of c << SHIFT | o for each g."""
    g = key >> SHIFT
    first = np.flatnonzero(np.diff(g, prepend=-1))
    near = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(c << SHIFT | key & MASK))
    return pa.RecordBatch.from_arrays([pa.array(g[first]), near], ["g", "near"])


def contexts(train: DataFrame, held: np.ndarray, count: np.ndarray, kind: np.ndarray, several: bool) -> DataFrame:
    """g, near: the neighbours of every clustered held word, from one pass over the texts and one exchange.

    g is the word's number and a part, numbers of neighbours being spread over 1 + count / PART parts (PARTS at most), so that no list grows with
    the corpus. near holds c << SHIFT | 2 * neighbour (+ 1 where it stands before the word). The tail (number len(held)) and the end (the next one)
    keep only what they have with each other, as all else stands with the word they meet. A word is its own neighbour once, as the one after it.
    several: words that aren't held may be clustered, so their pairs are left to far_pairs."""
    parts = np.append(np.minimum(1 + count // PART, PARTS), [1, 1]).astype(np.int16)
    shared = train.sparkSession.sparkContext.broadcast((held, kind < 0, parts))
    tail = len(held)

    def run(batches):
        held, rare, parts = shared.value
        number = np.append(np.where(rare, tail, np.arange(tail)), -1 if several else tail).astype(np.int32)
        keys, counts = [], []

        def lists(pair, c):
            a, b = pair // (tail + 2), pair % (tail + 2)
            after, before = (a < tail) | (b >= tail), (b < tail) & (a != b)
            w, other = np.concatenate([a[after], b[before]]), np.concatenate([b[after], a[before]])
            o = 2 * other + np.repeat([0, 1], [after.sum(), before.sum()])
            key = ((w << PART_BITS | other % parts[w]) << SHIFT) | o
            order = np.argsort(key)
            return _grouped(key[order], np.concatenate([c[after], c[before]])[order])

        for _, t in slices(batches, most=SLICE):
            w = words(t, NOT_SPACE)
            a, b = _sequence(number[_number(held, w.hash)].astype(np.int64), w.at, tail + 1)
            both = (a >= 0) & (b >= 0)
            pair, c = np.unique(a[both] * (tail + 2) + b[both], return_counts=True)
            keys.append(pair)
            counts.append(c)
            if sum(map(len, keys)) >= MERGE_AT:
                pair, c = _merged(keys, counts)
                keys, counts = [pair], [c]
                if len(pair) >= MERGE_AT // 2:
                    yield lists(pair, c)
                    keys, counts = [], []
        if keys:
            yield lists(*_merged(keys, counts))

    def together(batches):
        key, c = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def summed(key, c):
            order = np.argsort(key, kind="stable")
            key, c = key[order], c[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            return key[first], np.add.reduceat(c, first) if len(first) else c

        for batch in batches:
            near = batch.column("near")
            code = near.flatten().to_numpy()
            g = np.repeat(batch.column("g").to_numpy(), np.diff(near.offsets.to_numpy()))
            key, c = summed(np.concatenate([key, g << SHIFT | code & MASK]), np.concatenate([c, code >> SHIFT]))
            if len(key):  # the last list may go on in the next batch
                done = int(np.searchsorted(key, key[-1] >> SHIFT << SHIFT))
                if done:
                    yield _grouped(key[:done], c[:done])
                key, c = key[done:], c[done:]
        if len(key):
            yield _grouped(key, c)
    rows = train.select("text").mapInArrow(run, LISTS)
    return keep(rows.repartition("g").sortWithinPartitions("g").mapInArrow(together, LISTS), "lm-contexts")


def _classes(batch: pa.RecordBatch, kinds: np.ndarray):
    """w of each row of contexts; and of each entry the row, the neighbour, its class, whether it stands before the word, and the count."""
    near = batch.column("near")
    code = near.flatten().to_numpy()
    other = (code & MASK) >> 1
    at = np.repeat(np.arange(len(batch)), np.diff(near.offsets.to_numpy()))
    return batch.column("g").to_numpy() >> PART_BITS, at, other, kinds[other].astype(np.int64), (code & 1).astype(bool), code >> SHIFT


def with_classes(pairs: DataFrame | None, far: DataFrame | None) -> DataFrame | None:
    """far_pairs with the present classes ka, kb of far words, -1 for all others; one table a sweep."""
    if pairs is None:
        return None
    of = [far.select(F.col("w").alias(x), F.col("k").alias(f"k{x}")) for x in "ab"]
    wide = pairs.join(of[0], "a", "left").join(of[1], "b", "left")
    return keep(wide.select("a", "b", "c", *[F.coalesce(x, F.lit(-1)).cast("long").alias(x) for x in ("ka", "kb")]), "lm-wide")


def far_rows(wide: DataFrame, kind: np.ndarray, by_class: bool = False) -> DataFrame:
    """w, k, s, c: the neighbours that words have in with_classes (number w, class k); with by_class, the class pairs."""
    shared = wide.sparkSession.sparkContext.broadcast(_kinds(kind))
    tail = len(kind)

    def joined(batches):
        kinds = shared.value.astype(np.int64)
        out = _Neighbours(by_class)
        for batch in batches:
            a, b, c, ka, kb = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("a", "b", "c", "ka", "kb"))
            a, b = np.where((a < 0) & (ka < 0), tail, a), np.where((b < 0) & (kb < 0), tail, b)
            out.add(a, b, np.where(a < 0, ka, kinds[np.maximum(a, 0)]), np.where(b < 0, kb, kinds[np.maximum(b, 0)]), c)
            if out.full() and (batch := out.merged()) is not None:
                yield batch
        yield from out.rest()
    return wide.mapInArrow(joined, ROWS)


def _kinds(kind: np.ndarray) -> np.ndarray:
    """Classes by number, one byte each: held words, the tail, the end."""
    return np.append(kind, [CLASSES, CLASSES + 1]).astype(np.int8)


def class_pairs(near: DataFrame, kind: np.ndarray, wide: DataFrame | None) -> np.ndarray:
    """Class bigrams under the present classes: each task sums its lists to one square."""
    shared = near.sparkSession.sparkContext.broadcast(_kinds(kind))
    tail, m = len(kind), CLASSES + 2

    def run(batches):
        kinds, total = shared.value, np.zeros(m * m)
        for batch in batches:
            w, at, other, k, before, c = _classes(batch, kinds)
            own = kinds[w].astype(np.int64)[at]
            use = ~before | (other >= tail)  # pairs of two clustered words stand in the list of the first
            total += np.bincount(np.where(before, k * m + own, own * m + k)[use], c[use], minlength=m * m)
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got // m), pa.array(got % m), pa.array(total[got].astype(np.int64))], ["k", "s", "c"])
    rows = near.mapInArrow(run, "k long, s long, c long")
    if wide is not None:
        rows = rows.unionByName(far_rows(wide, kind, by_class=True).select("k", "s", "c"))
    g = np.zeros((m, m))
    for r in rows.groupBy("k", "s").agg(F.sum("c").alias("c")).collect():
        g[r["k"], r["s"]] = r["c"]
    shared.unpersist()
    return g


def _value(g: np.ndarray) -> float:
    return _xlogx(g).sum() - _xlogx(g.sum(1)).sum() - _xlogx(g.sum(0)).sum()


def best(at: np.ndarray, k: np.ndarray, s: np.ndarray, c: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The class of the largest gain for each word, all others as they are. k: present classes; at, s, c: word number, neighbour, count."""
    n, m = len(k), CLASSES + 2
    dense = np.zeros((n, OWN + 1))
    dense[at, s] = c
    out, inn, own = dense[:, :IN], dense[:, IN:OWN], dense[:, OWN:]
    mine = np.arange(m) == k[:, None]
    gain = np.zeros((n, m))
    for side, this, that, first in ((out, out, inn, 0), (inn, inn, out, IN)):
        here = np.flatnonzero((s >= first) & (s < first + m))
        for i in range(0, len(here), 1 << 14):
            j = here[i:i + (1 << 14)]
            w, d, x = at[j], s[j] - first, c[j][:, None]
            base = (g.T if first == 0 else g)[d] - mine[w] * x - np.where((d == k[w])[:, None], that[w] + mine[w] * own[w], 0)
            new = np.flatnonzero(np.diff(w, prepend=-1))  # rows of a word stand together
            gain[w[new]] += np.add.reduceat(_xlogx(base + x) - _xlogx(base), new)
    diagonal = np.diagonal(g) - mine * (out + inn + own)
    gain += _xlogx(diagonal + out + inn + own) - _xlogx(diagonal + out) - _xlogx(diagonal + inn) + _xlogx(diagonal)
    for margin, x in ((g.sum(1), out), (g.sum(0), inn)):
        moved = x.sum(1, keepdims=True) + own
        left = margin - mine * moved
        gain -= _xlogx(left + moved) - _xlogx(left)
    return np.argmax(gain[:, :CLASSES], axis=1)


def _half(h: np.ndarray) -> np.ndarray:
    """Halves of the words by a bit of their hashes without the last place."""
    return h >> np.asarray(7, h.dtype) & np.asarray(1, h.dtype) == 1


def _goes(k: np.ndarray, half: np.ndarray, sweep: int) -> np.ndarray:
    """In the first sweep the words outside the classes move in; later, one half of the words moves at a time."""
    return k == CLASSES if sweep == 0 else half == bool(sweep % 2)


def moves(near: DataFrame, held: np.ndarray, count: np.ndarray, kind: np.ndarray, wide: DataFrame | None, g: np.ndarray, sweep: int) -> DataFrame:
    """w, k of words that a sweep may move, and of all far words.

    One pass over the lists of contexts without an exchange; only words of several parts, and all if there are far words, are summed by word first."""
    tail, several = len(held), wide is not None
    half, parted = _half(held >> np.uint64(1)), np.append(count >= PART, [False, False])
    shared = near.sparkSession.sparkContext.broadcast((half, parted, _kinds(kind), g))

    def run(batches):
        half, parted, kinds, g = shared.value
        for batch in batches:
            for i in range(0, len(batch), 4096):
                w, at, other, k, before, c = _classes(batch.slice(i, 4096), kinds)
                word = w < tail
                go = word.copy()
                go[word] = _goes(kinds[w[word]], half[w[word]], sweep)
                s = np.where(before, IN + k, np.where(other == w[at], OWN, k))
                dense = np.bincount((at * (OWN + 1) + s)[go[at]], c[go[at]], minlength=len(w) * (OWN + 1)).reshape(len(w), -1)
                open_ = go & (parted[w] | several)
                ready = np.flatnonzero(go & ~open_)
                if len(ready):
                    j, s = np.nonzero(dense[ready])
                    new = best(j, kinds[w[ready]], s, dense[ready][j, s], g)
                    yield _rows(w[ready], new, np.full(len(ready), -1), np.zeros(len(ready), np.int64))
                if open_.any():
                    j, s = np.nonzero(dense * open_[:, None])
                    yield _rows(w[j], kinds[w[j]], s, dense[j, s].astype(np.int64))

    def rest(batches):
        halves, _, _, g = shared.value
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                w, k = (part.column(x).to_numpy().astype(np.int64) for x in ("w", "k"))
                near = part.column("near")
                at = np.repeat(np.arange(len(w)), np.diff(near.offsets.to_numpy()))
                s, c = (near.flatten().field(x).to_numpy().astype(np.int64) for x in ("s", "c"))
                half = np.zeros(len(w), bool)
                half[w >= 0], half[w < 0] = halves[w[w >= 0]], _half(-1 - w[w < 0])
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.where(_goes(k, half, sweep), best(at, k, s, c, g), k))], ["w", "k"])
    rows = keep(near.mapInArrow(run, ROWS), "lm-rows")
    sums = rows.filter("s >= 0")
    if several:
        sums = sums.unionByName(far_rows(wide, kind).filter(~F.col("w").isin(tail, tail + 1)))
    sums = sums.groupBy("w", "k", "s").agg(F.sum("c").alias("c")).groupBy("w", "k").agg(F.collect_list(F.struct("s", "c")).alias("near"))  # at most OWN + 1 rows a word
    return keep(rows.filter("s < 0").select("w", "k").unionByName(sums.mapInArrow(rest, "w long, k long")), "lm-moves")


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["w", "k", "s", "c"])


def spread(train: DataFrame, held: np.ndarray, count: np.ndarray, kind: np.ndarray, far: DataFrame | None) -> tuple[np.ndarray, DataFrame | None, np.ndarray]:
    """Classes of held words (-1: the tail) and of far words (w, k), and the class bigrams. kind: CLASSES for words that are in no class yet."""
    pairs = keep(far_pairs(train, held), "lm-pairs") if far is not None else None
    near = contexts(train, held, count, kind, far is not None)
    last = None
    for sweep in range(SPREAD):
        wide = with_classes(pairs, far)
        g = class_pairs(near, kind, wide)
        if sweep > 1 and _value(g) < _value(last[2]):
            return last
        if sweep > 1 and _value(g) - _value(last[2]) < SPREAD_GAIN * abs(_value(last[2])):
            return kind, far, g
        last = kind, far, g
        new = moves(near, held, count, kind, wide, g, sweep)
        mine = new.filter("w >= 0").toArrow()
        kind = kind.copy()
        kind[mine.column("w").to_numpy()] = mine.column("k").to_numpy()
        far = new.filter("w < 0") if far is not None else None
    g = class_pairs(near, kind, with_classes(pairs, far))
    return last if SPREAD > 1 and _value(g) < _value(last[2]) else (kind, far, g)


@dataclass
class Model:
    """All that the tasks need: held words with counts, their class and log10 emission, log10 class bigrams, and the tail's rule."""
    held: np.ndarray
    count: np.ndarray
    kind: np.ndarray
    emission: np.ndarray
    step: np.ndarray
    least: int
    discount: float
    tail_tokens: int
    log_unknown: float
    train_tokens: int
    types: int
    far: bool


def fit(train: DataFrame) -> tuple[Model, DataFrame, int]:
    """The model, the words that aren't held (w, c, k; k is null in the tail), and the number of texts."""
    counts = keep(word_counts(train), "lm-counts")
    texts = train.count()
    held, c, sums = frequent_words(counts)
    rare = counts.filter(F.col("c") < sums["least"])
    order = np.lexsort((held, -c))
    top = np.sort(order[c[order] >= SEEN][:LISTED])
    kind = np.where(c >= SEEN, CLASSES, -1)
    if len(top):
        kind[top] = exchange(pair_counts(train, held[top]))[:-2]
    number = -1 - F.shiftrightunsigned("w", 1)
    far = rare.filter(F.col("c") >= SEEN).select(number.alias("w"), F.lit(CLASSES).cast("long").alias("k")) if sums["least"] > SEEN else None
    kind, far, by_class = spread(train, held, c, kind, far)
    k = CLASSES + 2
    right = by_class.sum(0)
    unigram = (right + 1) / (right.sum() + k)
    step = np.log10((by_class + KAPPA * unigram) / (by_class.sum(1, keepdims=True) + KAPPA))
    tail_types, tail_tokens = sums["tail_types"], sums["tail_tokens"]
    discount = (sums["ones"] + 1) / (sums["ones"] + 1 + 2 * (sums["twos"] + 1))
    inside = by_class.sum(0)  # each word of a class is once the later one of a pair
    emission = np.log10(np.where(kind < 0, (c - discount) / (tail_tokens + 1), c / np.maximum(inside[kind], 1)))
    if far is not None:
        rare = rare.withColumn("_id", number).join(far.select(F.col("w").alias("_id"), "k"), "_id", "left").select("w", "c", F.when(F.col("c") >= SEEN, F.col("k")).alias("k"))
        inner = F.element_at(F.array(*[F.lit(float(x)) for x in inside]), (F.coalesce("k", F.lit(0)) + 1).cast("int"))
        rare = rare.withColumn("e", F.when(F.col("k").isNotNull(), F.log10(F.col("c") / inner)))
    else:
        rare = rare.select("w", "c", F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("e"))
    model = Model(held, c, np.where(kind < 0, CLASSES, kind).astype(np.int8), emission, step, sums["least"], discount, tail_tokens,
                  float(np.log10((discount * tail_types + 1) / (tail_tokens + 1))), sums["tokens"] + texts, sums["types"] + (texts > 0), far is not None)
    return model, rare, texts


def scored(docs: DataFrame, model: Model, rare: DataFrame, texts: int) -> DataFrame:
    """doc_id, held_out if it came along, n_tokens, n_known, base_score, score, perplexity of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = model.train_tokens + model.types + 1.0

    def run(batches):
        m, row = shared.value, TaskContext.get().partitionId() << 40
        last = len(m.step) - 1
        for batch, t in slices(batches, most=SLICE):
            w = words(t, NOT_SPACE)
            at = _number(m.held, w.hash)
            found = at < len(m.held)
            kind = np.full(len(at), CLASSES)
            kind[found] = m.kind[at[found]]
            log, plain = np.zeros(len(at)), np.zeros(len(at))
            log[found], plain[found] = m.emission[at[found]], np.log10((m.count[at[found]] + 1) / whole)
            of_word = np.repeat(np.arange(len(t)), np.diff(w.at))
            score = np.bincount(of_word, log, minlength=len(t))
            if not m.far:
                score += _steps(m.step, kind, w.at, last)
            base = np.bincount(of_word, plain, minlength=len(t)) + np.log10((texts + 1) / whole)
            known = np.bincount(of_word[found], minlength=len(t)) + (texts > 0)
            rest_at = np.concatenate([[0], np.cumsum(~found)])[w.at].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(rest_at), pa.array(signed(w.hash[~found])))
            # with far words, the classes of a row wait for the join: one byte a word, -1 where it is still open
            kinds = pa.ListArray.from_arrays(pa.array(w.at.astype(np.int32)), pa.array(np.where(found, kind, -1).astype(np.int8))) if m.far else pa.nulls(len(t), pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(row + np.arange(len(t))), pa.array(np.diff(w.at) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), rest, kinds],
                [*batch.schema.names[:-1], "_row", "n_tokens", "_known", "_base", "_score", "_rest", "_kinds"])
            row += len(t)

    def stepped(batches):
        m = shared.value
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(batch.column("_size").to_numpy())]).astype(np.int64)
            kind = batch.column("_kinds").flatten().to_numpy().astype(np.int64)
            kind[kind < 0] = batch.column("_new").flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(_steps(m.step, kind, at, len(m.step) - 1))], [*batch.schema.names[:-3], "_steps"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    out = keep(docs.mapInArrow(run, f"{fields}, _row long, n_tokens long, _known long, _base double, _score double, _rest array<long>, _kinds array<tinyint>"), "lm-rows")
    words_ = out.select("_row", F.posexplode("_rest").alias("_at", "w"))
    c = F.coalesce(F.col("c"), F.lit(0))
    log = F.coalesce("e", F.log10(F.when(c > 0, (c - F.lit(model.discount)) / F.lit(model.tail_tokens + 1.0))))
    rest = words_.join(rare, "w", "left").select("_row", "_at", F.coalesce("k", F.lit(CLASSES)).alias("_k"), (c > 0).cast("long").alias("k"),
                                                 F.log10((c + 1) / F.lit(whole)).alias("b"), F.coalesce(log, F.lit(model.log_unknown)).alias("s"))
    new = [F.transform(F.array_sort(F.collect_list(F.struct("_at", "_k"))), lambda x: x["_k"]).alias("_new")] if model.far else []
    rest = rest.groupBy("_row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"), *new)
    own = [f.name for f in docs.schema.fields[:-1]]
    out = out.drop("_rest").join(rest, "_row", "left")
    if model.far:
        head = [*own, "n_tokens", "_known", "_base", "_score", "k", "b", "s"]
        none = F.array().cast("array<bigint>")
        out = out.select(*head, (F.col("n_tokens") - 1).alias("_size"), "_kinds", F.coalesce("_new", none).alias("_new"))
        out = out.mapInArrow(stepped, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-3]) + ", _steps double")
    else:
        out = out.withColumn("_steps", F.lit(0.0))
    score = F.col("_score") + F.col("_steps") + F.coalesce("s", F.lit(0.0))
    return out.select(
        *own, "n_tokens", (F.col("_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))


def _steps(step: np.ndarray, kind: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """Sum of the class steps of each text."""
    now, then = _sequence(kind, at, end)
    return np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at) + 1), step[now, then], minlength=len(at) - 1)


def score(docs: DataFrame, fold: int = 2, of: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs (doc_id, text).

    A null text is empty: it has one token, the end. Texts of any length are taken whole; repeated rows count and are scored each; without
    training rows every word is unknown; an empty table gives no rows; other columns aren't read."""
    model, rare, texts = fit(docs.filter(training(docs, fold, of)))
    rows = docs.select("doc_id", (~training(docs, fold, of)).alias("held_out"), "text")
    return scored(rows, model, rare, texts)
