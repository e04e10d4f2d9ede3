"""Secrets in texts: three base patterns, and windows of high entropy.

The method looks at candidates, the maximal runs of TOKEN characters. In each candidate it takes the maximal runs of every character class
and slides a window over them. A step takes one character out of the window and one in, so the sum of c * log2(c) over the window's counts
changes by two terms; these come from a table of whole numbers, so that no error builds up however long a run is. Windows of one
class whose entropy reaches the class's limit, and which hold digits and letters, join to spans. Spans that an allow-list knows are
dropped, as are those inside a base match. The windows of all runs of a slice of texts are computed at once.
"""
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tocsin.llm.shared import Carried
from tocsin.llm.spans import runs, spread
from tocsin.llm.words import Texts, slices

# The base patterns, the least lengths (of the value, of the match) and the order of kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")


def _set(characters: bytes) -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[list(characters)] = True
    return inside


DIGITS = b"0123456789"
SMALL, LARGE = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = _set(DIGITS + b"abcdef")
DIGIT, LETTER = _set(DIGITS), _set(SMALL + LARGE)
TOKEN = _set(DIGITS + SMALL + LARGE + b"+/_.=-")


@dataclass(frozen=True)
class Kind:
    """A character class: its alphabet, the window's length, and the least entropy of a window in bits a character."""
    alphabet: bytes
    window: int
    least: float


# Classes from the narrowest to the widest. Random strings of a class lie about 0.3 bits above its limit.
CLASSES = (Kind(DIGITS + b"abcdef", 20, 3.0), Kind(DIGITS + b"ABCDEF", 20, 3.0), Kind(DIGITS + SMALL, 20, 3.55),
           Kind(DIGITS + LARGE, 20, 3.55), Kind(DIGITS + SMALL + LARGE + b"+/_=-", 20, 3.8))
LEAST_OF_EACH = 2  # digits, and letters, in a window

# What looks random and is no secret (identifiers, named check sums, addresses, paths, placeholders).
ALLOWED = (rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", rb"(?i:sha1|sha256|sha384|sha512|md5)[-=_][A-Za-z0-9+/=]+",
           rb"(?i)example|sample|dummy|placeholder|changeme|xxxx|1234567890|abcdefgh", rb"www\.[A-Za-z0-9.-]+",
           rb"(?:/[A-Za-z0-9_.-]*[A-Za-z_.-]){2,}", rb"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]?[0-9.]*)")

UNIT = 1 << 32
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _terms(window: int) -> np.ndarray:
    """c * log2(c) for c up to the window's length, in units."""
    c = np.arange(window + 1)
    return np.round(np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0) * UNIT).astype(np.int64)


def entropies(symbols: np.ndarray, run: np.ndarray, window: int) -> np.ndarray:
    """Entropy of the window that ends at each place, in bits a character; -1 where less than a window of its run lies before.

    symbols: bytes of all runs end to end; run: the number of each place's run, ascending."""
    n = len(symbols)
    if not n:
        return np.zeros(0)
    term = _terms(window)
    place = np.arange(n)
    begin = np.searchsorted(run, run)                     # where the place's run starts
    key = (run * 256 + symbols).astype(np.int64)
    order = np.argsort(key, kind="stable")                # places by run and symbol, ascending
    near = key[order] * (n + 1) + order                   # sorted, as places of one key ascend
    rank = np.empty(n, np.int64)
    rank[order] = place

    def earlier(at: np.ndarray, since: np.ndarray) -> np.ndarray:
        """How many places since `since` and before `at` hold the symbol of `at`."""
        return rank[at] - np.searchsorted(near, key[at] * (n + 1) + since)
    came = earlier(place, np.maximum(place - window + 1, begin))
    change = term[came + 1] - term[came]
    full = place - begin >= window                        # a character leaves
    gone = place[full] - window
    # its count in the window it leaves: itself and later ones up to the place before
    upto = np.searchsorted(near, key[gone] * (n + 1) + place[full]) - rank[gone]
    change[full] -= term[upto] - term[upto - 1]
    total = np.cumsum(change)
    before = np.where(begin > 0, total[begin - 1], 0)
    out = np.log2(window) - (total - before) / (UNIT * window)
    out[place - begin < window - 1] = -1.0
    return out


def _ahead(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def high(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: Kind) -> np.ndarray:
    """Which bytes lie in a window of the class that reaches its limit. start, end: candidates, in order."""
    covered = np.zeros(len(data) + 1, np.int64)
    if not len(start):
        return covered[:-1] > 0
    inside = np.zeros(len(data), bool)
    where = spread(start, end)
    inside[where] = _set(kind.alphabet)[data[where]]
    lo, hi = runs(inside, np.concatenate([start, end]), kind.window)
    if not len(lo):
        return covered[:-1] > 0
    at = spread(lo, hi)
    symbols = data[at]
    run = np.repeat(np.arange(len(lo)), hi - lo)
    h = entropies(symbols, run, kind.window)
    digits, letters = _ahead(DIGIT[symbols]), _ahead(LETTER[symbols])
    ends = np.flatnonzero(h >= kind.least)
    for flags in (digits, letters):
        ends = ends[flags[ends + 1] - flags[ends + 1 - kind.window] >= LEAST_OF_EACH]
    np.add.at(covered, at[ends] - kind.window + 1, 1)
    np.add.at(covered, at[ends] + 1, -1)
    return np.cumsum(covered)[:-1] > 0


def base(t: Texts) -> list[tuple[int, int, int, int]]:
    """(row, place of the kind, start, end) in bytes of every base match."""
    out = []
    for row in range(len(t)):
        lo = int(t.at[row])
        text = t.data[lo:t.at[row + 1]].tobytes()
        if b"=" in text or b":" in text:
            out += [(row, 0, lo + m.start(), lo + m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
        if b"AKIA" in text:
            out += [(row, 1, lo + m.start(), lo + m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    start, end = runs(HEX[t.data], t.at, LEAST_HEX)
    rows = np.searchsorted(t.at, start, "right") - 1
    return out + [(int(r), 2, int(s), int(e)) for r, s, e in zip(rows, start, end)]


def windows(t: Texts, known: list[tuple[int, int, int, int]], allow: Sequence[re.Pattern], exact: frozenset[bytes]) -> list[tuple[int, int, int, int]]:
    """The spans that the method adds, in bytes."""
    start, end = runs(TOKEN[t.data], t.at, min(k.window for k in CLASSES))
    covered = np.zeros(len(t.data), bool)
    for kind in CLASSES:
        covered |= high(t.data, start, end, kind)
    lo, hi = runs(covered, np.concatenate([start, end, t.at]), 1)
    of, out = np.searchsorted(start, lo, "right") - 1, []
    rows = np.searchsorted(t.at, lo, "right") - 1
    by_row: dict[int, list[tuple[int, int]]] = {}
    for r, _, s, e in known:
        by_row.setdefault(r, []).append((s, e))
    bounds: dict[int, tuple[bytes, list[tuple[int, int]]]] = {}
    for row, s, e, c in zip(rows.tolist(), lo.tolist(), hi.tolist(), of.tolist()):
        if any(a <= s and e <= b for a, b in by_row.get(row, ())):
            continue
        if c not in bounds:  # one look at each candidate
            text = t.data[start[c]:end[c]].tobytes()
            bounds[c] = text, [(m.start() + int(start[c]), m.end() + int(start[c])) for p in allow for m in p.finditer(text)]
        text, harmless = bounds[c]
        if text in exact or any(a < e and s < b for a, b in harmless):
            continue
        out.append((row, 3, s, e))
    return out


def found(t: Texts, allow: Sequence[re.Pattern], exact: frozenset[bytes]) -> tuple[np.ndarray, ...]:
    """row, kind, start, end of all spans by row, start and kind, in code points of their row."""
    known = base(t)
    spans = np.array(sorted((r, s, k, e) for r, k, s, e in known + windows(t, known, allow, exact)), np.int64).reshape(-1, 4)
    row, start, kind, end = spans.T
    inner = np.flatnonzero((t.data & 0xC0) == 0x80)  # bytes that begin no code point

    def point(at):
        return at - t.at[row] - (np.searchsorted(inner, at) - np.searchsorted(inner, t.at[row]))
    return row, kind, point(start), point(end)


def scanned(docs: DataFrame, columns: list[str], allow: Sequence[bytes] = ALLOWED, exact: Sequence[str] = ()) -> DataFrame:
    """The named columns of every row of docs with `spans`: kind, start and end (code points, end exclusive) by start, then kind.

    A base span covers its whole match (key and value for `assign`). allow: patterns whose matches in a candidate suppress the method's spans
    they touch; exact: candidates that are no secrets. Neither touches base spans. Null and empty texts have no spans; texts of any length
    are scanned whole (one of many megabytes alone in its slice); repeated rows are scanned each; an empty table gives none; other
    columns of docs aren't read, and a named column called spans gives way."""
    patterns, known = [re.compile(p) for p in allow], frozenset(x.encode() for x in exact)

    def run(batches):
        for batch, t in slices(batches, "t", 1 << 20):
            row, kind, start, end = found(t, patterns, known)
            at = np.searchsorted(row, np.arange(len(t) + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(KINDS).take(pa.array(kind)), pa.array(start), pa.array(end)], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(at), items)], [*batch.schema.names[:-1], "spans"])
    own = Carried(docs, columns)
    schema = f"{own.schema}, spans {SPANS}" if own.schema else f"spans {SPANS}"
    return own.back(own.df.mapInArrow(run, schema), "spans")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
