"""Language of a text by unigram pieces, summed over all segmentations.

Pieces are those of a fixed public vocabulary. Each language has a probability for every piece, fitted by expectation maximisation: all
segmentations of the training words are summed by the forward and backward pass, and expected piece counts become probabilities. A
text's likelihood in a language is the product over its words of the sum over their segmentations. Words are runs of letters, small, with a
mark in front; longer words than LONGEST bytes are cut there before they are segmented, by definition of the model. Every single byte is a piece, so that
each word has a segmentation.

Scoring sums each distinct word of a batch once, all words side by side. The fit uses at most about MOST_TEXTS labelled texts and
the MOST_WORDS most frequent words of a language in them (documented bounds).
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tocsin.llm.shared import Carried
from tocsin.llm.words import BYTE_VALUES, PLACES, POWERS, Texts, mix, slices, span_hashes, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_TEXTS, MOST_WORDS, ROUNDS = 1600, 12_000, 3
LONGEST = 48
SCALE = 64.0      # each byte's share of a probability is scaled by it, so that products stay in range
FLOOR = 0.02      # added to each expected count

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def small(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin letters that UTF-8 writes as C3 80 to C3 9E."""
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]] += 0x20
    return out


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """Small-letter pieces of the vocabulary, the mark of a word's start as a blank, then all single bytes."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    real = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    spelled = {p.replace("▁", " ").lower().encode() for p in real}
    keep = {p for p in spelled if 0 < len(p) <= 16 and all(LETTERS[b] for b in p.lstrip(b" ")) and p.rfind(b" ") <= 0}
    return sorted(keep | {bytes([b]) for b in range(256)})


def _hashes(data: bytes, at: np.ndarray) -> np.ndarray:
    return span_hashes(np.frombuffer(data, np.uint8), at[:-1], at[1:], False)


class Lattice:
    """The pieces that fit at every place of a list of distinct words, laid end to end with their mark."""

    def __init__(self, data: np.ndarray, at: np.ndarray, known: np.ndarray, longest: int):
        """known: sorted hashes of the pieces."""
        self.data, self.at, self.n = data, at, np.diff(at)
        self.order = np.argsort(-self.n, kind="stable")
        self.begin, self.size = at[:-1][self.order], self.n[self.order]
        end_of = np.repeat(at[1:], self.n)
        place = np.arange(len(data))
        self.piece = []
        for length in range(1, longest + 1):
            found = np.full(len(data), -1, np.int32)
            real = np.flatnonzero(place + length <= end_of)
            h = _window_hashes(data, real, length)
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            found[real] = np.where(known[k] == h, k, -1)
            self.piece.append(found)

    def _at(self, step):
        return self.begin[:int(np.searchsorted(-self.size, -step, "right"))]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: pieces x languages (scaled). Sums over all segmentations of the first bytes of each word: a row
        per byte, and one before the first byte of each word (place + word number)."""
        out = np.zeros((len(self.data) + len(self.n), p.shape[1]))
        shift = np.repeat(np.arange(len(self.n)), self.n)
        self.row = np.arange(len(self.data)) + shift  # row before the byte at a place
        base = self.at[:-1] + np.arange(len(self.n))
        out[base] = 1
        for step in range(1, int(self.size[0]) + 1 if len(self.size) else 1):
            here = self._at(step)
            total = np.zeros((len(here), p.shape[1]))
            for length in range(1, min(step, len(self.piece)) + 1):
                start = here + step - length
                k = self.piece[length - 1][start]
                fits = np.flatnonzero(k >= 0)
                if len(fits):
                    total[fits] += out[self.row[start[fits]]] * p[k[fits]]
            out[self.row[here + step - 1] + 1] = total
        return out

    def whole(self, forward: np.ndarray) -> np.ndarray:
        return forward[self.at[1:] + np.arange(len(self.n))]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece, given how often each word stands in each language."""
        ahead = self.forward(p)
        total = self.whole(ahead)
        back = np.zeros_like(ahead)
        back[self.at[1:] + np.arange(len(self.n))] = counts / np.maximum(total, 1e-300)
        out = np.zeros_like(p)
        for step in range(int(self.size[0]) - 1 if len(self.size) else -1, -1, -1):
            here = self._at(step + 1)
            for length in range(1, len(self.piece) + 1):
                start = here + step
                k = self.piece[length - 1][start]
                fits = np.flatnonzero(k >= 0)
                if len(fits):
                    now, then = self.row[start[fits]], self.row[start[fits] + length - 1] + 1
                    part = p[k[fits]] * back[then]
                    back[now] += part
                    np.add.at(out, k[fits], ahead[now] * part)
        return out


def _window_hashes(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hash of data[s:s + length] for each s, as span_hashes gives."""
    total = np.zeros(len(start), np.uint64)
    for k in range(length):
        total += BYTE_VALUES[data[start + k]] * POWERS[k]
    return mix(total ^ (np.full(len(start), length, np.uint64) * np.uint64(PLACES[0])))


@dataclass
class Model:
    names: list[str]
    known: np.ndarray       # sorted hashes of pieces
    p: np.ndarray           # pieces x languages: probabilities, scaled
    longest: int


def distinct_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's distinct words with their mark (bytes, bounds), the number of each word of the texts, and the bounds of each text's."""
    t = Texts(small(t.data), t.at, t.null)
    w = words(t, LETTERS, fold=False)
    cuts = (w.end - w.start + LONGEST - 1) // LONGEST
    start, end, h, at = w.start, w.end, w.hash, w.at
    if len(cuts) and cuts.max() > 1:  # cut what is longer than LONGEST
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.repeat(w.start, cuts) + nth * LONGEST
        end = np.minimum(start + LONGEST, np.repeat(w.end, cuts))
        h = span_hashes(t.data, start, end, False)
        at = np.concatenate([[0], np.cumsum(cuts)])[w.at]
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    size = end[first] - start[first]
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    data = np.full(bounds[-1], 32, np.uint8)
    own = np.repeat(np.arange(len(size)), size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data[bounds[own] + 1 + inner] = t.data[start[first][own] + inner]
    return data, bounds, number, at


def likelihoods(t: Texts, m: Model) -> np.ndarray:
    """Log likelihood of each text in each language; 0 for texts without letters."""
    data, bounds, number, at = distinct_words(t)
    if not len(number):
        return np.zeros((len(t), len(m.names)))
    lattice = Lattice(data, bounds, m.known, m.longest)
    word = np.log(np.maximum(lattice.whole(lattice.forward(m.p)), 1e-300)) - (np.diff(bounds) * np.log(SCALE))[:, None]
    total = np.concatenate([np.zeros((1, word.shape[1])), np.cumsum(word[number], 0)])
    return total[at[1:]] - total[at[:-1]]


def held_out(fold: int = 0, of: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))


def fit(docs: DataFrame, path: str = VOCABULARY, fold: int = 0, of: int = 5) -> Model:
    """Fits to text and lang of rows outside the held-out fold. Null texts and languages aren't used."""
    known = docs.filter(~held_out(fold, of) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count().orderBy("lang")
    n = {r["lang"]: r["count"] for r in sizes.toLocalIterator()}
    names = sorted(n)
    most = MOST_TEXTS / max(len(names), 1)
    part = sizes.select(F.col("lang").alias("_l"), F.least(F.lit(1.0), most / F.col("count")).alias("_part"))
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    few = known.select("doc_id", "lang", "text").join(F.broadcast(part) if len(names) < 10_000 else part, F.col("lang") == F.col("_l")).filter(place < F.col("_part"))

    def run(batches):
        for batch, t in slices(batches):
            data, bounds, number, at = distinct_words(t)
            lang = batch.column(0).to_pylist()
            names_ = sorted(set(lang))
            of_row = np.array([names_.index(x) for x in lang])
            of_word = np.repeat(of_row, np.diff(at))
            k = len(bounds) - 1
            count = np.bincount(of_word * k + number, minlength=k * len(names_))
            got = np.flatnonzero(count)
            spelled = [bytes(data[bounds[i]:bounds[i + 1]]) for i in got % max(k, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([names_[i] for i in got // max(k, 1)], pa.string()), pa.array(spelled, pa.binary()), pa.array(count[got])],
                                             ["lang", "w", "n"])
    sums = few.select("lang", "text").mapInArrow(run, "lang string, w binary, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    got = sums.withColumn("_r", rank).filter(F.col("_r") <= MOST_WORDS).select("lang", "w", "n").toArrow()
    spelled, of_lang, times = got.column("w").to_pylist(), got.column("lang").to_pylist(), got.column("n").to_numpy()
    distinct = {w: k for k, w in enumerate(sorted(set(spelled)))}
    counts = np.zeros((len(distinct), len(names)))
    where = {name: k for k, name in enumerate(names)}
    for w, name, c in zip(spelled, of_lang, times):
        counts[distinct[w], where[name]] += c
    all_ = pieces(path)
    h = _hashes(b"".join(all_), np.concatenate([[0], np.cumsum([len(p) for p in all_])]))
    order = np.argsort(h)
    size = np.array([len(p) for p in all_], float)[order]
    longest = int(size.max())
    p = np.full((len(all_), len(names)), 1.0 / len(all_))
    if distinct:
        data = np.frombuffer(b"".join(distinct), np.uint8)
        lattice = Lattice(data, np.concatenate([[0], np.cumsum([len(w) for w in distinct])]), h[order], longest)
        for _ in range(ROUNDS):
            e = lattice.expected(_scaled(p, size), counts) + FLOOR
            p = e / e.sum(0)
    return Model(names, h[order], _scaled(p, size), longest)


def _scaled(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    return p * (SCALE ** size)[:, None]


def identified(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The named columns of every row with lang_pred and score (the share of the best language, all taken as equally likely before).

    Null texts and texts without a letter get `und` and 0, as do all rows where no language was learned. Texts of any length are read whole;
    repeated rows alike; an empty table gives no rows. Only the named columns and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = Carried(docs, columns)

    def run(batches):
        m = shared.value
        for batch, t in slices(batches, "t", 8 << 20):
            ascii_ = np.flatnonzero(LETTERS[t.data] & (t.data < 128))
            real = np.diff(np.searchsorted(ascii_, t.at)) > 0
            for i in np.flatnonzero(~real):
                real[i] = any(c.isalpha() for c in bytes(t.data[t.at[i]:t.at[i + 1]]).decode("utf-8", "replace"))
            if m.names:
                ll = likelihoods(t, m)
                best = ll.argmax(1)
                score = 1 / np.exp(np.maximum(ll - ll.max(1, keepdims=True), -700)).sum(1)
                names = [m.names[k] if ok else "und" for k, ok in zip(best, real)]
            else:
                names, score = ["und"] * len(t), np.zeros(len(t))
                real = np.zeros(len(t), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(real, score, 0.0))],
                                             [*batch.schema.names[:-1], "lang_pred", "score"])
    return own.back(own.df.mapInArrow(run, f"{own.schema}, lang_pred string, score double"), "lang_pred", "score")
