"""Spelling variants: words at one edit's distance, found by PartEnum signatures on their letter multisets.

A word is seen as a binary vector with a dimension for every (letter, how often it stood before). One inserted or deleted letter flips one
dimension, one replaced letter two, so near words lie within a Hamming distance of two. The dimensions are dealt to parts by a fixed
hash; vectors that differ in k of them agree on all but k parts, so two near words share the signature of at least one choice of
parts with k left out. Words of one length are enumerated with two parts left out, words of neighbouring lengths with one. Signatures
meet in an equi join, candidates are verified by the edit distance itself.
"""
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tocsin.llm.shared import keep
from tocsin.llm.spans import runs, spread
from tocsin.llm.words import FOLD, Texts, mix, slices, span_hashes

# Share of tokens that lose a letter (one in SLIPS), least length and count of a word, least ratio of a form's count.
SLIPS, LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 97, 5, 3, 2

PARTS = 8   # parts of the dimensions: 28 choices with two left out, 8 with one
LONG = 64   # bytes up to which checksums of tokens are computed side by side
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LEAD = 0xC3  # first byte of U+00C0 to U+00FF, and of nothing else


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1)).astype(np.uint32)
    return c


CRC = _crc_table()


def letters(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of A-Z, a-z and U+00C0 to U+00FF."""
    inside = LETTER[t.data]
    lead = np.flatnonzero(t.data == LEAD)
    inside[lead] = True
    inside[lead + 1] = True
    return runs(inside, t.at)


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of every span after a prefix whose own crc32 is `state`."""
    c = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = end - start
    by_size = np.argsort(-size, kind="stable")
    whole = by_size[size[by_size] > LONG]
    live = by_size[len(whole):]
    live_size = size[live]
    for j in range(int(live_size[0]) if len(live) else 0):
        live = live[:np.searchsorted(-live_size, -j, "left")]
        live_size = live_size[:len(live)]
        c[live] = CRC[(c[live] ^ data[start[live] + j]) & np.uint32(0xFF)] ^ (c[live] >> np.uint32(8))
    out = c ^ np.uint32(0xFFFFFFFF)
    for i in whole:
        out[i] = zlib.crc32(data[start[i]:end[i]].tobytes(), int(state[i]))
    return out


def tokens(ids: list, t: Texts) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of a slice with their counts, after the slips. Only words of LEAST_LENGTH code points or more."""
    start, end = letters(t)
    row = np.searchsorted(t.at, start, "right") - 1
    state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    data = FOLD[t.data]
    h = checksums(data, start, end, state[row]).astype(np.int64)
    slip = h % SLIPS == 0
    leads = np.concatenate([[0], np.cumsum(data == LEAD)])
    points = end - start - (leads[end] - leads[start])
    counts = Counter()
    for s, e, k in zip(start[slip & (points > LEAST_LENGTH)], end[slip & (points > LEAST_LENGTH)], h[slip & (points > LEAST_LENGTH)]):
        word = data[s:e].tobytes().decode()
        at = int(k) % len(word)
        counts[word[:at] + word[at + 1:]] += 1
    plain = ~slip & (points >= LEAST_LENGTH)
    start, end = start[plain], end[plain]
    _, first, n = np.unique(span_hashes(data, start, end, False), return_index=True, return_counts=True)
    start, end = start[first], end[first]
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    body = data[spread(start, end)] if len(start) else np.zeros(0, np.uint8)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(body.tobytes()))
    return (pa.concat_arrays([words.cast(pa.string()), pa.array(list(counts), pa.string())]),
            np.concatenate([n.astype(np.int64), np.array(list(counts.values()), np.int64)]))


def counted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """word, n of the texts of docs: letter runs in small letters, one in SLIPS short of a letter as its checksum with the row's key says.
    Null and empty texts have none, a null key counts as empty, repeated rows count each, an empty table has no words. Only key and
    text are read."""
    def run(batches):
        for batch, t in slices(batches, "text"):
            words, n = tokens(batch.column(0).to_pylist(), t)
            yield pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def vectors(words: list[str], parts: int = PARTS) -> np.ndarray:
    """A hash of each word's vector in each part: equal sets of dimensions give equal sums."""
    size = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((codes, row))
    row, codes = row[order], codes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
    times = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    dimension = mix((codes << np.uint64(32)) + times.astype(np.uint64) + np.uint64(1))
    out = np.zeros((len(words), parts), np.uint64)
    np.add.at(out, (row, (dimension % np.uint64(parts)).astype(np.int64)), mix(dimension))
    return out


def signatures(words: list[str], left_out: int, parts: int = PARTS) -> np.ndarray:
    """One column for every choice of `left_out` parts: a hash of the choice and of the vector without these parts."""
    v = vectors(words, parts)
    whole = v.sum(axis=1, dtype=np.uint64)
    return np.stack([mix(mix(whole - v[:, list(c)].sum(axis=1, dtype=np.uint64)) + np.uint64(i + 1))
                     for i, c in enumerate(combinations(range(parts), left_out))], axis=1)


def signed(words: DataFrame, left_out: int, longer: int = 0) -> DataFrame:
    """word, n and one row for every signature (_sig) of the words. Signatures hold the length, taken as `longer` letters more. Joins of them
    are hinted to merge: Spark's size of these rows is that of the words, so that it would broadcast 28 rows for every word."""
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                strings = part.column(0).to_pylist()
                size = np.array([len(w) + longer for w in strings], np.uint64) + np.uint64(left_out << 32)
                sig = mix(signatures(strings, left_out) + mix(size)[:, None])
                again = pa.array(np.repeat(np.arange(len(strings)), sig.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(again), part.column(1).take(again), pa.array(sig.ravel().view(np.int64))],
                                                 ["word", "n", "_sig"])
    return words.select("word", "n").mapInArrow(run, "word string, n long, _sig long").hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every pair of words at an edit distance of one, once. words: word (distinct, not null), n. The join makes the rows
    that share a signature; it is split by Spark where a signature is frequent, and nothing is capped."""
    def side(df, name):
        return df.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"), "_sig")
    level = signed(words, 2)
    same = side(level, "a").join(side(level, "b"), "_sig").filter(F.col("a") < F.col("b"))
    other = side(signed(words, 1, 1), "a").join(side(signed(words, 1), "b"), "_sig")
    return same.union(other).filter(F.levenshtein("a", "b", 1) == 1).drop("_sig").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following the forms ends. forms: word, form, both not null; counts at least double on every step, so chains are
    short and have no cycle. Every round doubles the steps taken. Joins are hinted to merge, here and in `grouped`: files of words are a
    twentieth of what a broadcast of them holds."""
    at = keep(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_far")).hint("merge")
        step = keep(at.join(ahead, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")),
                    "variant-roots")
        at = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            return at


def grouped(words: DataFrame, pairs: DataFrame, ratio: int = LEAST_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word. The form is the most frequent near word (of several the first in code points'
    order) if it is at least `ratio` times as frequent; the root is the last form, or the word itself. No words give no rows."""
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")).alias("near")).union(
        pairs.select(F.col("b"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("form"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    rows = words.join(best.hint("merge"), "word", "left")
    good = -F.col("near.less") >= ratio * F.col("n")
    rows = keep(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("near.form")).alias("form"),
                            F.when(good, -F.col("near.less")).alias("form_n")), "variant-forms")
    ends = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of docs (see counted and grouped)."""
    words = keep(counted(docs, key), "variant-words")
    return grouped(words, keep(near_pairs(words), "variant-pairs"))
