"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole texts of one task, of about SHARD bytes. Words that no item holds can't be part of a match, so they and runs too
short for any window are left out, PART bytes of text at a time; the rest, joined by separators, is indexed: suffix array, Burrows-Wheeler transform, wavelet
matrix with rank tables, and every SAMPLE-th suffix position. All windows of all items are searched backwards at once; their
occurrences are found by walking to the next sampled position; overlapping occurrences merge to spans.

Items are read by the driver in blocks of at most BLOCK words; each block is one pass over the texts that carries the hits of the passes
before, so a benchmark of any size is searched in full.
"""
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tocsin.llm.shared import Carried
from tocsin.llm.words import LETTER_OR_DIGIT, Texts, parts, slices, texts, words

WINDOW = 10
SHARD = 16 << 20
PART = 1 << 20     # bytes of a shard's text whose words are held at a time; a longer text stands alone
SAMPLE = 16
BLOCK = 4_000_000  # item words sent to the tasks at a time (8 bytes each)
FOUND = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by doubling the compared length."""
    n, k = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while True:
        then = np.zeros(n, np.int64)
        then[:max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + then
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order][1:] != key[order][:-1])
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, k = new, 2 * k


class Index:
    """FM-index of a sequence of small positive numbers that ends with its only 0."""

    def __init__(self, t: np.ndarray):
        order = suffix_array(t)
        self.n, self.levels = len(t), max(int(t.max()).bit_length(), 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=(1 << self.levels)))])
        last = t[order - 1]
        self.ones, self.zeros, row = [], [], last
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands in the first i of the transform."""
        start = np.zeros_like(i)
        for ones, zeros, level in zip(self.ones, self.zeros, reversed(range(self.levels))):
            bit = (symbol >> level) & 1 == 1
            i = np.where(bit, zeros + ones[i], i - ones[i])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return i - start

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one position earlier."""
        symbol, start, row = np.zeros_like(i), np.zeros_like(i), i
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[row + 1] > ones[row]
            row = np.where(bit, zeros + ones[row], row - ones[row])
            start = np.where(bit, zeros + ones[start], start - ones[start])
            symbol = symbol * 2 + bit
        return self.before[symbol] + row - start

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo..hi-1 of the suffixes that start with each window (one per line of the matrix)."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        live = np.arange(len(windows))
        for k in reversed(range(windows.shape[1])):
            c = windows[live, k]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi[hi < lo] = lo[hi < lo]
        dead = np.ones(len(windows), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps, live = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live := live[~self.sampled[at[live]]]):
            at[live] = self.back(at[live])
            steps[live] += 1
        return self.samples[self.sample_rank[at]] + steps


@dataclass
class Phrases:
    """Windows of a block of items: sorted word hashes (a word's number is its place plus 2: 1 separates, 0 ends), and per window length the distinct windows with
    the items that hold each."""
    vocabulary: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    names: list[str]


def phrases(items: list[tuple[str, str]]) -> Phrases:
    w = words(texts(pa.array([t for _, t in items], pa.large_string())), LETTER_OR_DIGIT)
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    vocabulary, ids = np.unique(w.hash, return_inverse=True)
    made: dict[int, dict[tuple, set]] = {}
    for row, (name, _) in enumerate(items):
        own = (ids[w.at[row]:w.at[row + 1]] + 2).tolist()
        size = min(WINDOW, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            made.setdefault(size, {}).setdefault(tuple(own[k:k + size]), set()).add(number[name])
    by_length = []
    for size, found in sorted(made.items()):
        held = [sorted(x) for x in found.values()]
        by_length.append((np.array(list(found), np.int64).reshape(-1, size), np.concatenate([[0], np.cumsum([len(x) for x in held])]),
                          np.array([k for x in held for k in x], np.int64)))
    return Phrases(vocabulary, by_length, names)


def known_runs(t: Texts, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n + 1 bounds of each row's words; the line of the runs of known words, long enough for the shortest window and each inside one text,
    that ends with its only 0; the word each place of the line stands for. Words of PART bytes of text are held at a time."""
    least = p.by_length[0][0].shape[1] if p.by_length else 0
    counts, lines, backs, done = [np.zeros(1, np.int64)], [], [], 0
    for _, _, part in parts(t, PART):
        w = words(part, LETTER_OR_DIGIT)
        counts.append(w.at[1:] + done)
        if least and len(w.hash):
            place = np.minimum(np.searchsorted(p.vocabulary, w.hash), len(p.vocabulary) - 1)
            known = p.vocabulary[place] == w.hash
            starts = np.zeros(len(known), bool)
            starts[w.at[:-1][w.at[:-1] < len(known)]] = True
            first = np.flatnonzero(known & (starts | ~np.concatenate([[False], known[:-1]])))
            last = np.flatnonzero(known & np.concatenate([starts[1:] | ~known[1:], [True]]))
            long_ = last - first + 1 >= least
            first, size = first[long_], (last - first + 1)[long_]
            at = np.concatenate([[0], np.cumsum(size + 1)])
            word_at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
            t_at = word_at + np.repeat(at[:-1] - first, size)
            line, back = np.ones(at[-1], np.int64), np.zeros(at[-1], np.int64)
            line[t_at], back[t_at] = place[word_at] + 2, word_at + done
            lines.append(line)
            backs.append(back)
        done += len(w.hash)
    end = [np.zeros(1, np.int64)]
    return np.concatenate(counts), np.concatenate(lines + end), np.concatenate(backs + end)


def search(t: Texts, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n + 1 bounds of each row's words, which of all words are hit, and the distinct (row, item number) pairs."""
    at, line, back = known_runs(t, p)
    hit, none = np.zeros(at[-1], bool), np.zeros((0, 2), np.int64)
    if len(line) == 1:
        return at, hit, none
    index, pairs = Index(line), [none]
    edge = np.zeros(len(hit) + 1, np.int32)
    for windows, held_at, held in p.by_length:
        lo, hi = index.search(windows)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        begin = back[index.locate(rows)]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + windows.shape[1], -1)
        doc = np.searchsorted(at, begin, "right") - 1
        seen = np.unique(np.stack([doc, which], 1), axis=0) if len(doc) else none
        many = held_at[seen[:, 1] + 1] - held_at[seen[:, 1]]
        item = np.repeat(held_at[seen[:, 1]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs.append(np.stack([np.repeat(seen[:, 0], many), held[item]], 1))
    return at, np.cumsum(edge, dtype=np.int32)[:-1] > 0, np.unique(np.concatenate(pairs), axis=0)


def blocks(benchmark: DataFrame) -> list[Phrases]:
    """Items (item_id, text) in blocks of bounded size; null texts have no words, a null id is the empty name."""
    out, block, size = [], [], 0
    for r in benchmark.select(benchmark["item_id"].cast("string").alias("i"), "text").toLocalIterator():
        if r["text"] is None:
            continue
        size += len(r["text"]) // 2 + 1
        block.append((r["i"] or "", r["text"]))
        if size >= BLOCK:
            out.append(phrases(block))
            block, size = [], 0
    return [*out, phrases(block)]


def _spans(t: Texts, row: int, hit: np.ndarray) -> np.ndarray:
    """Bytes start and end of the merged hits of a row, within its text, whose words are found again."""
    lo, hi = t.at[row], t.at[row + 1]
    w = words(Texts(t.data[lo:hi], np.array([0, hi - lo]), t.null[row:row + 1]), LETTER_OR_DIGIT)
    own = np.concatenate([[False], hit, [False]])
    first, last = np.flatnonzero(own[1:-1] & ~own[:-2]), np.flatnonzero(own[1:-1] & ~own[2:])
    return np.stack([w.start[first], w.end[last]], 1)


def _searched(docs: DataFrame, benchmark: DataFrame, columns: list[str], keep_text: bool) -> tuple[Carried, DataFrame]:
    """The carried columns under their place names with what was found, and the text as `t` if it is kept."""
    own, found = Carried(docs, columns), blocks(benchmark)
    df, n = own.df, len(columns)
    for k, block in enumerate(found):
        shared, last = docs.sparkSession.sparkContext.broadcast(block), k == len(found) - 1

        def run(batches, shared=shared, k=k, last=last):
            p = shared.value
            for batch, t in slices(batches, "t", SHARD):
                at, hit, pairs = search(t, p)
                names = [[] for _ in range(len(t))]
                for row, item in pairs.tolist():
                    names[row].append(p.names[item])
                if k:  # hits of the passes before
                    names = [sorted({*a, *b}) for a, b in zip(names, batch.column(n + 2).to_pylist())]
                    for row, bits in enumerate(batch.column(n + 1).to_pylist()):
                        own_hits = hit[at[row]:at[row + 1]]
                        own_hits |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own_hits)).astype(bool)
                head, heads = batch.columns[:n], batch.schema.names[:n]
                if not last:
                    bits = [np.packbits(hit[at[i]:at[i + 1]]).tobytes() for i in range(len(t))]
                    yield pa.RecordBatch.from_arrays([*head, batch.column(n), pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))],
                                                     [*heads, "t", "hit", "names"])
                    continue
                count = np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
                where = [_spans(t, i, hit[at[i]:at[i + 1]]) if count[i] else [] for i in range(len(t))]
                cols = [pa.array(np.diff(at)), pa.array(count.astype(np.int64)), pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names], pa.string()), pa.array(count > 0),
                        pa.array([[{"start": int(a), "end": int(b)} for a, b in x] for x in where],
                                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*head, *cols, *([batch.column(n)] if keep_text else [])],
                                                 [*heads, *FOUND, *(["t"] if keep_text else [])])
        end = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>"
        fields = [own.schema, end, *(["t string"] if keep_text else [])] if last else [own.schema, "t string, hit binary, names array<string>"]
        df = df.mapInArrow(run, ", ".join(f for f in fields if f))
    return own, df


def searched(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of every row with n_words, n_hit, n_items, items_sha256, contaminated, spans (bytes from, to, merged).

    A null or empty text has no words and no hits; a text longer than a shard is one shard; repeated rows are searched each; an empty
    benchmark hits nothing and an empty table gives no rows. Only the named columns are read, and they travel under place names."""
    own, df = _searched(docs, benchmark, columns, False)
    return own.back(df, *FOUND)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the rows that hold no window of an item."""
    names = [c for c in docs.columns if c != "text"]
    _, df = _searched(docs, benchmark, names, True)
    place = {c: f"c{i}" for i, c in enumerate(names)} | {"text": "t"}
    return df.filter(~F.col("contaminated")).select(*[F.col(place[c]).alias(c) for c in docs.columns])
