"""N-gram Jaccard join by a blocked sparse product of the document by shingle matrix.

Rows of the matrix are the distinct sets of five-word shingles (copies share one row). Two sets can only reach the limit if they meet in
their prefixes: the first n - ceil(0.75 n) + 1 shingles in one global order. The order puts frequent shingles last, so that a
passage shared by many texts rarely stands in a prefix; which shingles count as frequent is estimated on a part of the texts and only
moves work, never results, as any common order is right.

The first rounds take the easy links: each set names KEYS pairs of its least re-hashed shingles, and the sets that share one are compared with
one of them, drawn anew for each key and round, as long as their labels differ. Components of these links shrink large groups of near copies to
one label. The last round is the product: prefix columns that hold more than one label are multiplied by themselves across labels, overlap
counts are summed per pair, and pairs whose count plus what can follow stays below the bound given by both sizes are dropped. A link inside
a component changes nothing, so leaving those pairs out loses none.

Possible pairs of all rounds then meet a second bound: sets differ in at least as many shingles as the parities of their hashes
on PARITY_BITS places do. What is left is compared in full; those sets alone are read again from the texts and moved.
"""
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tocsin.llm.graph import components, widened
from tocsin.llm.shared import keep
from tocsin.llm.words import NOT_SPACE, Texts, mix, signed, slices, windows, words

WORDS, PERCENT = 5, 75
KEYS = 8                  # pairs of least re-hashed shingles of the easy rounds
EASY_ROUNDS = 2           # of them; more only save work later
COLUMN_ROUNDS = 1         # of the same kind over prefix columns
SLICE = 1 << 20           # bytes of text whose words are held at a time in a task; a longer text stands alone
PARITY_BITS = 2048        # places of the parity bound, in longs of 64
FOLDED = [f"f{k}" for k in range(8)]  # the same bound on 512 places, carried by the cells of the product
PART = 8                  # frequent shingles are looked for in one of so many texts
FREQUENT, MOST_FREQUENT = 3, 500_000  # seen so often there; so many of them at most are sent to the tasks (8 bytes each)
FILTER_BITS = (20, 27)    # least and most bits, as powers of two, of a filter sent to the tasks


def prefix(n):
    """How many shingles of a set of n stand in its prefix."""
    return n - (PERCENT * n + 99) // 100 + 1


def _sets(t: Texts, use: np.ndarray | None = None) -> list[np.ndarray]:
    """For each row, its sorted distinct shingle hashes; none for rows not to be used."""
    if use is not None and not use.any():
        return [np.zeros(0, np.uint64)] * len(t)
    w = words(t, NOT_SPACE)
    return [np.unique(windows(w.hash[w.at[i]:w.at[i + 1]], WORDS)) if use is None or use[i] else np.zeros(0, np.uint64) for i in range(len(t))]


def _identity(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s + np.uint64(len(s))).sum(dtype=np.uint64)]))[0]) if len(s) else 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(signed(flat)))


def frequent(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that stand in many texts, from one of PART texts."""
    def run(batches):
        for _, t in slices(batches, most=SLICE):
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *_sets(t)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n.astype(np.int64))], ["s", "n"])
    part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PART)) == 0).select("text").mapInArrow(run, "s long, n long")
    often = part.groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = often.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, node (identity of the set; equal sets are equal nodes), keys and parities of every row."""
    salts = mix(np.arange(1, 2 * KEYS + 1, dtype=np.uint64))

    def run(batches):
        for batch, t in slices(batches, most=SLICE):
            found = _sets(t)
            keys, bits = [], []
            for s in found:
                least = np.array([mix(s ^ salt).min() for salt in salts], np.uint64) if len(s) else s
                keys.append(mix(least[::2] * np.uint64(3) + least[1::2] + np.arange(KEYS, dtype=np.uint64)) if len(s) else s)
                odd = np.bincount((s % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
                bits.append(np.packbits(odd.astype(bool)).view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int64()),
                 pa.array(signed(np.array([_identity(s) for s in found], np.uint64))), _lists(keys), _lists(bits)],
                ["doc_id", "n", "node", "keys", "bits"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(docs)}, n long, node long, keys array<long>, bits array<long>")


def prefixes(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """node, doc_id and prefix of every row with shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        often = shared.value
        for batch, t in slices(batches, most=SLICE):
            found = _sets(t)
            first = []
            for s in found:
                if len(often) and len(s):
                    hot = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    s = np.concatenate([s[~hot], s[hot]])
                first.append(s[:prefix(len(s))] if len(s) else s)
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.array([_identity(s) for s in found], np.uint64))), batch.column(0), _lists(first)],
                                             ["node", "doc_id", "prefix"])
    return docs.select("doc_id", "text").mapInArrow(run, f"node long, doc_id {_kind(docs)}, prefix array<long>").filter(F.size("prefix") > 0)


class Filter:
    """A bit per hashed value, of bounded size: tells surely what is not in, so rows can be dropped before a shuffle."""

    def __init__(self, values: DataFrame, count: int):
        column = values.columns[0]
        self.bits = 1 << min(max((16 * max(count, 1)).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
        place = F.pmod(F.col(column), F.lit(self.bits)) + 1
        maps = values.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
        packed = np.zeros(self.bits // 8, np.uint8)
        got = maps.toArrow()  # one job, however many partitions; at most 2**FILTER_BITS[1] bits
        for k, m in zip(got.column("k").to_pylist(), got.column("m").to_pylist()):
            at = (k - 1) * 4096
            packed[at:at + 4096] = np.frombuffer(m, np.uint8)[:len(packed) - at]
        self.shared = values.sparkSession.sparkContext.broadcast(packed)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        at = values.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of the named nodes (node, least doc_id), read again from the texts that stand for them. A filter drops the other texts
    before the shuffle; the few that pass it wrongly, or rows that repeat, meet no pair or the same pair again."""
    count = nodes.count()
    wanted, ids = Filter(nodes.select("node"), count), Filter(nodes.select(F.xxhash64("least").alias("i")), count)

    def run(batches):
        for batch, t in slices(batches, most=SLICE):
            may = ids.may_hold(batch.column(1).to_numpy())
            found = _sets(t, may)
            node = np.array([_identity(s) for s in found], np.uint64).view(np.int64)
            use = np.flatnonzero(may & wanted.may_hold(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[use]), _lists([found[i] for i in use])], ["node", "shingles"])
    return docs.select("text", F.xxhash64("doc_id").alias("_i")).mapInArrow(run, "node long, shingles array<long>").filter(F.size("shingles") > 0)


def _near(na: Column, nb: Column) -> Column:
    return (100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na)


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs a, b of nodes that the parity bound leaves, with the least doc_id of both."""
    own = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("bits").alias(f"_{x}"), F.col("least").alias(f"_i{x}"))
    met = pairs.join(own("a"), "a").join(own("b"), "b")
    differ = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = (F.col("_na") + F.col("_nb") - differ) / 2
    return met.filter((100 + PERCENT) * most >= PERCENT * (F.col("_na") + F.col("_nb"))).select("a", "b", "_ia", "_ib")


def compared(pairs: DataFrame, s: DataFrame) -> DataFrame:
    """Those pairs a, b whose sets (node, shingles) reach the limit."""
    both = s.select(F.col("node").alias("a"), F.col("shingles").alias("_a")).join(pairs.select("a", "b"), "a")
    both = both.join(s.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.select("a", "b", common.alias("_c"), (F.size("_a") + F.size("_b")).alias("_n")).filter(
        100 * F.col("_c") >= PERCENT * (F.col("_n") - F.col("_c"))).select("a", "b").distinct()


def easy_labels(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The labels of the components of the links found by shared keys in a few rounds."""
    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > 1).select("key")
    keyed = keep(keyed.join(often, "key").withColumn("label", F.col("node")), "near-keys")
    nodes = keyed.select("node").distinct().join(classes.select("node", "least"), "node")
    s = keep(sets_of(docs, keep(nodes, "near-nodes")), "near-sets")
    labels = None
    for turn in range(EASY_ROUNDS):
        pairs = drawn_pairs(keyed if labels is None else _labelled(keyed, labels), "key", turn)
        new = keep(compared(possible(pairs, classes), s), "near-links")
        labels = components(new) if labels is None else widened(labels, new)
    return labels


def prefix_cells(rows: DataFrame) -> DataFrame:
    """node, label, n, prefix of every class; the cells s, node, label, n, at of all prefix columns that hold more than one label."""
    narrow = rows.select(F.explode("prefix").alias("s"), F.col("label").alias("l"))
    mixed = keep(narrow.groupBy("s").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).filter("lo < hi").select("s"), "near-columns")
    held = Filter(mixed, mixed.count())

    def run(batches):
        for b in batches:
            p = b.column(3)
            flat, size = p.flatten().to_numpy(zero_copy_only=False), p.value_lengths().to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(size)])
            row = np.repeat(np.arange(len(p)), size)
            got = np.flatnonzero(held.may_hold(flat))
            cut = pa.array(row[got])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[got]), b.column(0).take(cut), b.column(1).take(cut), b.column(2).take(cut), pa.array((got - begin[row[got]]).astype(np.int64))],
                ["s", "node", "label", "n", "at"])
    cells = rows.select("node", "label", "n", "prefix").mapInArrow(run, "s long, node long, label long, n long, at long")
    return keep(cells.join(mixed, "s", "left_semi"), "near-cells")


def drawn_pairs(cells: DataFrame, key: str, turn: int) -> DataFrame:
    """Every node with one drawn for each of its keys, where their labels differ and their sizes allow a link."""
    drawn = cells.groupBy(key).agg(F.min_by(F.struct("node", "n", "label"), F.xxhash64("node", key, F.lit(turn))).alias("p"))
    met = cells.join(drawn, key).filter((F.col("label") != F.col("p.label")) & _near(F.col("n"), F.col("p.n")))
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _labelled(cells: DataFrame, labels: DataFrame) -> DataFrame:
    return cells.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _may_link() -> Column:
    """Whether a link is possible if this common shingle is the first one of both sets: all common ones are then in the shorter rest from it on.

    The first common one of a link always passes, and whatever passes stands before what doesn't, as places rise together."""
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return (F.col("label_a") != F.col("label_b")) & _near(F.col("n_a"), F.col("n_b")) & ((100 + PERCENT) * rest >= PERCENT * (F.col("n_a") + F.col("n_b")))


def product_pairs(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of nodes of different labels that the product of the cells leaves possible.

    Columns of two cells, which are most, are one pair each and need no join. In the others the parities, folded to fewer places, bound each pair
    before it is made. Over both, the count of common ones met plus the rest after the last is a last bound."""
    own = ("node", "label", "n", "at")
    size = cells.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(*own)).alias("_a"), F.max(F.struct(*own)).alias("_b"))
    two = size.filter("m = 2").select(*[F.col(f"_a.{c}").alias(f"{c}_a") for c in own], *[F.col(f"_b.{c}").alias(f"{c}_b") for c in own]).filter(_may_link())
    wide = keep(cells.join(cells.groupBy("s").count().filter("count > 2").select("s"), "s", "left_semi"), "near-wide")
    longs = len(FOLDED)
    fold = [reduce(lambda x, y: x.bitwiseXOR(y), [F.get("bits", F.lit(k + longs * j)) for j in range(PARITY_BITS // 64 // longs)]).alias(f) for k, f in enumerate(FOLDED)]
    wide = wide.join(classes.select("node", *fold), "node")
    a = wide.select("s", *[F.col(c).alias(f"{c}_a") for c in (*own, *FOLDED)])
    b = wide.select("s", *[F.col(c).alias(f"{c}_b") for c in (*own, *FOLDED)])
    differ = sum((F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in FOLDED), F.lit(0))
    met = a.join(b, "s").filter((F.col("node_a") < F.col("node_b")) & _may_link()
                                & ((100 + PERCENT) * (F.col("n_a") + F.col("n_b") - differ) >= 2 * PERCENT * (F.col("n_a") + F.col("n_b"))))
    pairs = met.select(two.columns).union(two).groupBy("node_a", "node_b").agg(
        F.count(F.lit(1)).alias("c"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return pairs.filter((100 + PERCENT) * (F.col("c") + rest - 1) >= PERCENT * (F.col("n_a") + F.col("n_b"))).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def other_labels(docs: DataFrame, columns: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """labels after all links between nodes of different labels: first along drawn centres of the prefix columns, to join what is still
    apart at the cost of one row a cell, then by the product of the columns that still hold several labels."""
    cells = prefix_cells(columns)

    def checked(pairs):
        pairs = keep(possible(pairs, classes), "near-pairs")
        nodes = pairs.select(F.col("a").alias("node"), F.col("_ia").alias("least")).union(pairs.select("b", "_ib")).distinct()
        return keep(compared(pairs, sets_of(docs, keep(nodes, "near-nodes"))), "near-links")
    for turn in range(COLUMN_ROUNDS):
        labels = widened(labels, checked(drawn_pairs(cells, "s", turn)))
        cells = keep(_labelled(cells, labels), "near-cells")
        several = cells.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("s")
        cells = keep(cells.join(several, "s", "left_semi"), "near-cells")
    return widened(labels, checked(product_pairs(cells, classes)))


def near(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; other columns aren't read).

    component_id is the least doc_id that links reach, the row's own included. Texts that are null or have no word have no shingles
    and stay alone; equal texts share a component, also under one id; a null id is passed on and is no id of a component; an
    empty table gives no rows."""
    rows = keep(sketches(docs), "near-rows")
    classes = keep(rows.filter("n > 0").groupBy("node").agg(*[F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "keys", "bits")]]), "near-classes")
    labels = easy_labels(docs, classes)
    labelled = classes.join(labels, "node", "left").select("node", "least", "n", F.coalesce("label", "node").alias("label"))
    first = prefixes(docs, frequent(docs)).withColumnRenamed("node", "_node")
    columns = labelled.join(first, (F.col("node") == F.col("_node")) & F.col("least").eqNullSafe(F.col("doc_id"))).select("node", "label", "n", "prefix")
    labels = other_labels(docs, keep(columns, "near-prefixes"), classes, labels)
    of = classes.select("node", "least").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least")
    of = of.select("node", F.col("label")).join(of.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    one = rows.select("doc_id", "n", "node").filter("n > 0").join(of, "node")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return one.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose doc_id is surely none of ids, and the rest: those that are, and the few others that a filter lets pass."""
    held = Filter(ids.select(F.xxhash64("doc_id").alias("i")), ids.count())

    @F.arrow_udf("boolean")
    def may(hashed: pa.Array) -> pa.Array:
        return pa.array(held.may_hold(hashed.to_numpy(zero_copy_only=False)))
    passes = may(F.xxhash64("doc_id"))
    return docs.filter(~passes), docs.filter(passes)


def representatives(docs: DataFrame) -> DataFrame:
    """One whole row of each component, that of the least doc_id; texts without words all stay.

    Of rows equal in id and text one stays: only ids that repeat are looked at a second time. Rows that neither concerns stay
    where they are; only the others' texts are moved."""
    found = keep(near(docs), "near-found")
    alone, stands = F.col("n_shingles") == 0, F.col("component_id").eqNullSafe(F.col("doc_id"))
    drop = keep(found.filter(~alone & ~stands).select("doc_id").join(found.filter(alone | stands).select("doc_id"), "doc_id", "left_anti").distinct(), "near-drop")
    twice = keep(found.filter(~alone).groupBy("doc_id").count().filter("count > 1").select("doc_id"), "near-twice")
    stay, rest = parted(docs, drop.union(twice))
    left = rest.join(drop, "doc_id", "left_anti")
    if twice.isEmpty():
        return stay.unionByName(left)
    same = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.unionByName(left.join(twice, "doc_id", "left_anti")).unionByName(same)
