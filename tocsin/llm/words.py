"""Words of a batch of texts as numpy arrays: bounds and 64-bit hashes, found on the UTF-8 bytes of an Arrow column.

Separators are ASCII, so bytes give the same words as characters. Hashes are 64-bit polynomial sums over fixed random values of
the bytes, mixed at the end; a shingle is hashed from the hashes of its words. Two different words or shingles are taken as equal
with a chance of about 2**-60.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Multipliers of the hashes.
STEP = 0x9E3779B97F4A7C13
PLACES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
SPAN = 1 << 19  # bytes hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))
POWERS, _DOWN = _powers(STEP, SPAN), _powers(pow(STEP, -1, 1 << 64), SPAN)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Word bytes of [^\x20\x09-\x0D]+, and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became small.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[48:58] = LETTER_OR_DIGIT[65:91] = LETTER_OR_DIGIT[97:123] = LETTER_OR_DIGIT[128:] = True


@dataclass
class Texts:
    """Texts of some rows: their bytes end to end, the n + 1 bounds, and which rows are null (they have no bytes)."""
    data: np.ndarray
    at: np.ndarray
    null: np.ndarray

    def __len__(self):
        return len(self.at) - 1


@dataclass
class Words:
    """Bounds of all words in Texts.data, their hashes, and the n + 1 bounds of each row's words."""
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray


def texts(column: pa.Array) -> Texts:
    column = column.cast(pa.large_string())
    n, null = len(column), column.is_null().to_numpy(zero_copy_only=False)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0]:at[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    if null.any() and (np.diff(at)[null] > 0).any():
        return texts(pa.array([v if v is not None else None for v in column.to_pylist()], pa.large_string()))
    return Texts(data, at - at[0], null)


def parts(t: Texts, most: int) -> Iterator[tuple[int, int, Texts]]:
    """Rows i..j-1 and their texts, at most `most` bytes at a time (a longer row stands alone)."""
    i = 0
    while i < len(t):
        j = max(i + 1, int(np.searchsorted(t.at, t.at[i] + most, "right")) - 1)
        lo, hi = t.at[i], t.at[j]
        yield i, j, Texts(t.data[lo:hi], t.at[i:j + 1] - lo, t.null[i:j])
        i = j


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cuts batches into parts of at most `most` bytes of text (a longer row stands alone)."""
    for batch in batches:
        for i, j, t in parts(texts(batch.column(batch.schema.get_field_index(column))), most):
            yield batch.slice(i, j - i), t


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """Hash of every data[start:end]; spans are in order and don't overlap."""
    out, values = np.empty(len(start), np.uint64), BYTE_VALUES[FOLD] if fold else BYTE_VALUES
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SPAN, "right")))
        base, top = int(start[i]), int(end[j - 1])
        up, down = (POWERS, _DOWN) if top - base <= SPAN else (_powers(STEP, top - base), np.ones(1, np.uint64))
        total = np.zeros(top - base + 1, np.uint64)
        np.cumsum(values[data[base:top]] * up[:top - base], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out ^ ((end - start).astype(np.uint64) * np.uint64(PLACES[0])))


def words(t: Texts, kind: np.ndarray = NOT_SPACE, fold: bool = True) -> Words:
    inside = kind[t.data]
    if not len(inside):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(t) + 1, np.int64))
    first = np.ones(len(inside), bool)  # the byte before is no part of the same word
    first[1:] = ~inside[:-1]
    inner = t.at[(t.at > 0) & (t.at < len(inside))]
    first[inner] = True
    start = np.flatnonzero(inside & first)
    last = np.ones(len(inside), bool)
    last[:-1] = first[1:] | ~inside[1:]
    end = np.flatnonzero(inside & last) + 1
    return Words(start, end, span_hashes(t.data, start, end, fold), np.searchsorted(start, t.at))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes; fewer words than n give their whole sequence as one, none give none."""
    if not len(h):
        return h
    n = min(n, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(PLACES[k % 5]) + h[k:len(h) - n + 1 + k]
        total = total ^ (total >> np.uint64(29))
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    """As the long that Spark holds."""
    return x.view(np.int64)
