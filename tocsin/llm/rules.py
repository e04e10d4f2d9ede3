"""Quality rules with a verdict per host.

Every text is measured on its own (lines and words as arrays of hashes, in Arrow batches); rows that break a rule fail. Failures are summed per
host, a beta prior is fitted to the hosts' rates by moments, each host's rate is shrunk to it, and hosts whose shrunk rate passes a
limit lose all their rows. Small hosts stay near the prior, so a few bad pages don't condemn them.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tocsin.llm.shared import Carried, keep
from tocsin.llm.words import NOT_SPACE, mix, slices, span_hashes, windows, words

# Limits of the base rules.
FEW_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MOST_FAILURES = 0.5    # shrunk rate above which a host is refused
PRECISION = (1.0, 1e4)  # least and most weight of the prior, in rows
FEW_HOSTS = 100_000    # up to so many refused hosts are broadcast, else joined

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_row(positions: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(positions, at))


def _again(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items equal another of their row, and which of them stand first in sorted order."""
    key = h ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    any_, first = np.zeros(len(key), bool), np.zeros(len(key), bool)
    any_[order], first[order] = same[:-1] | same[1:], ~same[:-1]
    return any_, first


def measures(t) -> dict[str, np.ndarray]:
    """The base measures of each row of a slice."""
    w = words(t, NOT_SPACE, fold=False)
    n = np.diff(w.at)
    line_break = np.flatnonzero(t.data == 10)
    start = np.sort(np.concatenate([t.at[:-1], line_break + 1]), kind="stable")
    end = np.sort(np.concatenate([line_break, t.at[1:]]), kind="stable")
    line_row = np.repeat(np.arange(len(t)), _per_row(line_break, t.at) + 1)
    with_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    _, first = _again(line_row[with_word], span_hashes(t.data, start, end, False)[with_word])
    dup = np.bincount(line_row[with_word][~first], minlength=len(t))
    row = np.repeat(np.arange(len(t)), n)
    covered = np.zeros(len(row), bool)
    if len(row) >= WINDOW:
        whole = np.flatnonzero(row[WINDOW - 1:] == row[:len(row) - WINDOW + 1])
        twice, _ = _again(row[whole], windows(w.hash, WINDOW)[whole])
        for k in range(WINDOW):
            covered[whole[twice] + k] = True
    inside = np.flatnonzero(NOT_SPACE[t.data] & ((t.data & 0xC0) != 0x80))
    return {"n_words": n, "word_chars": _per_row(inside, t.at), "n_symbols": _per_row(np.flatnonzero(SYMBOLS[t.data]), t.at),
            "n_dup_lines": dup, "n_repeat_words": np.bincount(row[covered], minlength=len(t))}


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of every row with its measures; texts may be null or empty (all measures 0) or of any length."""
    def run(batches):
        for batch, t in slices(batches, "t"):
            found = measures(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(v.astype(np.int64)) for v in found.values()]],
                                             [*batch.schema.names[:-1], *found])
    own = Carried(docs, columns)
    return own.back(own.df.mapInArrow(run, f"{own.schema}, {MEASURES}"), *[m.split()[0] for m in MEASURES.split(", ")])


def hosts(rows: DataFrame, host: str = "source") -> DataFrame:
    """host, n_docs, n_failed, rate: the share of failed rows, shrunk to a beta prior of the hosts' rates."""
    sums = rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    sums = keep(sums, "rule-hosts")
    share = F.col("n_failed") / F.col("n_docs")
    m, v = sums.agg(F.avg(share), F.var_pop(share)).first()
    m, v = m or 0.0, v or 0.0
    weight = min(max(m * (1 - m) / max(v, 1e-12) - 1, PRECISION[0]), PRECISION[1])
    return sums.withColumn("rate", (F.col("n_failed") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight)))


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row of docs (doc_id, text and the host; other columns aren't read).
    Null texts have no words and fail; a null host is a host; repeated rows are judged each; an empty table gives none."""
    rows = measured(docs, ["doc_id", host])
    failed = (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = keep(rows.withColumn("base_failed", failed), "rule-rows")
    refused = keep(hosts(rows, host).filter(F.col("rate") > MOST_FAILURES).select(F.col("host").alias("_h"), F.lit(True).alias("_no")), "rule-refused")
    refused = F.broadcast(refused) if refused.count() <= FEW_HOSTS else refused
    out = rows.join(refused, F.col(host).eqNullSafe(F.col("_h")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_no").isNull()).drop(host, "_h", "_no")
