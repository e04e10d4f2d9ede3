"""Prefix trie of conversations by fixed-length block hashing.

A conversation is a row of turns; the hash of its first d turns is the xor of one hash per (place, turn), 128 bits wide, so it can be summed in
any order and in pieces. Turns are cut into blocks of BLOCK. Conversations are grouped by the hash before a block (its start) first. A
start that one conversation reaches is a lone tail, and one whose members all continue with the same block has the same members
at all turns inside; both give their nodes without a look at turns of other members. Only where siblings part inside a
block are its members' turns grouped one by one.

A node is named by its smallest member and its depth. A conversation that is the smallest member of a node is so of all deeper nodes on its
path, hence every node of a subtree belongs to exactly one member of the subtree's top: sums over subtrees are sums over members of what each
owns deeper down, and need no walk along the tree.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tocsin.llm.shared import keep

BLOCK = 4        # turns of a block
CHUNK = 1024     # turns of a conversation that are put in a row at a time, a multiple of BLOCK
ENDS = 12        # bits of a conversation's id inside a part of an end list: 4,096 ids a part
BUSY = 10_000    # starts that hold this part of all blocks, or more, are sent to the tasks
RANGE = 256      # blocks of a conversation that one window takes
FAMILY, MOST_SHARED = 100, 6  # Fixed values of the rebuilding: ids of a family, and the divisor of the checksum
ID = ["depth", "q1", "q2"]


def hashed(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at, tie, d1, d2, size: the order column, the md5 of role, a zero character and text, two 64-bit hashes of role and text, and the
    text's code points. Null roles and texts count as empty; rows without a conversation belong to none and go."""
    r, t = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return turns.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{order}`").alias("at"), F.md5(F.concat(r, F.lit("\0"), t)).alias("tie"), F.xxhash64(F.lit(1), r, t).alias("d1"),
        F.xxhash64(F.lit(2), t, r).alias("d2"), F.length(t).cast("long").alias("size"))


def placed(turns: DataFrame) -> DataFrame:
    """conv, place, d1, d2, size: turns of a conversation numbered from 0 by `at` (null first), ties by their md5.

    Rows are sorted by ranges, so a conversation of any length is spread; each range numbers its own rows, and what a conversation has in the
    ranges before is added for the first conversation of a range, the only one that can have begun earlier: one row a range is collected."""
    order = [F.col("conv"), F.col("at").asc_nulls_first(), F.col("tie")]

    def number(batches):
        last, n = None, 0
        for batch in batches:
            conv = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            place = np.arange(len(conv)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            if last is not None and conv[0] == last:
                place[:int(np.argmax(np.append(conv != last, True)))] += n
            last, n = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(sorted_.select(F.spark_partition_id().alias("range"), "conv", "d1", "d2", "size").mapInArrow(
        number, "range int, conv long, d1 long, d2 long, size long, place long"), "trie-places")
    ends = rows.groupBy("range").agg(F.min("conv").alias("first"), F.max("conv").alias("last"),
                                     F.max(F.struct("conv", "place"))["place"].alias("place")).orderBy("range").collect()
    open_, behind = None, []
    for r in ends:
        before = open_[1] if open_ and open_[0] == r["first"] else 0
        if before:
            behind.append((r["range"], r["first"], before))
        open_ = (r["last"], r["place"] + 1 + (before if r["first"] == r["last"] else 0))
    if behind:
        add = F.broadcast(rows.sparkSession.createDataFrame(behind, "range int, conv long, before long"))  # at most one row a range
        rows = rows.join(add, ["range", "conv"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    return rows.select("conv", "place", "d1", "d2", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share the beginnings of the first of their family: the first h turns come from conversation c - c % FAMILY, the
    others are c's own after its first h, with h = crc32 of c's digits % MOST_SHARED. Takes and returns turns as of `placed`, and the
    conversations with their number of turns, which may be 0."""
    def first(conv: Column) -> Column:
        return conv - conv % FAMILY

    def shared(conv: Column) -> Column:
        return F.crc32(conv.cast("string")) % MOST_SHARED
    head = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("place") < MOST_SHARED - 1)).groupBy(F.col("conv").alias("family")).agg(
        F.array_sort(F.collect_list(F.struct("place", "d1", "d2", "size"))).alias("head"))  # at most five turns each
    head = keep(head, "trie-heads")
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({"family": first(F.col("conv")), "h": shared(F.col("conv"))})
    convs = keep(convs.join(head, "family", "left").select(
        "conv", "own", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,d1:bigint,d2:bigint,size:bigint>>")), F.lit(1), F.col("h").cast("int")).alias("head")), "trie-convs")
    length = F.size("head") + F.greatest(F.col("own") - shared(F.col("conv")), F.lit(0))
    sizes = head.select("family", F.size("head").alias("have"))
    own = turns.withColumn("h", shared(F.col("conv"))).filter(F.col("place") >= F.col("h")).withColumn("family", first(F.col("conv")))
    own = own.join(sizes, "family", "left").select(
        "conv", (F.col("place") - F.col("h") + F.least("h", F.coalesce("have", F.lit(0)))).alias("place"), "d1", "d2", "size")
    borrowed = convs.select("conv", F.explode("head").alias("t")).select("conv", "t.place", "t.d1", "t.d2", "t.size")
    return own.union(borrowed), convs.select("conv", length.cast("long").alias("turns"))


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, k, p1, p2, els, open: each block of each conversation with the hash before it and its elements (hash up to and with it, size, last).

    Element 0 is the textless root, element d the d-th turn. Every conversation has a last block with less than BLOCK elements, empty if need
    be. Hashes are relative to the conversation's chunk; `open` marks conversations of more than one chunk."""
    place = F.col("place") + 1
    elements = turns.select("conv", place.alias("at"), F.xxhash64(place, "d1", "d2").alias("g1"), F.xxhash64("d2", "d1", place).alias("g2"), "size",
                            F.lit(0).alias("kind"))
    n = F.col("turns") + 1
    zero = F.lit(0).cast("long")

    def mark(at, kind):
        return F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"))
    marks = convs.select("conv", F.explode(F.array(mark(F.lit(0), 0), mark(n - 1, 1), mark(n, 2))).alias("m")).select(
        "conv", "m.at", zero.alias("g1"), zero.alias("g2"), zero.alias("size"), "m.kind")
    chunk = F.floor(F.col("at") / CHUNK).cast("long")
    rows = elements.union(marks).groupBy("conv", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("at", "kind", "g1", "g2", "size"))).alias("t"))  # at most CHUNK + 2 each

    def cut(batches):
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                lists = part.column(2)
                at, t = np.asarray(lists.offsets), lists.values
                get = lambda name: t.field(name).to_numpy(zero_copy_only=False)[at[0]:at[-1]]
                row = np.repeat(np.arange(len(part)), np.diff(at))
                where, kind = get("at"), get("kind")
                el = kind == 0
                ended = np.bincount(row[kind == 2], minlength=len(part)) > 0
                last = np.zeros(len(row), bool)
                hit = np.flatnonzero(kind == 1)  # stands right behind its element
                last[hit - 1] = True
                r, w, last = row[el], where[el], last[el]
                size, hashes = get("size")[el], []
                for name in ("g1", "g2"):
                    total = np.concatenate([[0], np.bitwise_xor.accumulate(get(name)[el])]).astype(np.int64)
                    begin = np.searchsorted(r, r)
                    hashes.append((total[1:] ^ total[begin], np.concatenate([[0], total[1:] ^ total[begin]]) if len(r) else np.zeros(1, np.int64)))
                # blocks: those with elements, and the empty last ones
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (w[1:] // BLOCK != w[:-1] // BLOCK)
                b = np.flatnonzero(new)
                br, bk = r[b], w[b] // BLOCK
                end_row, end_at = row[kind == 2], where[kind == 2]
                empty = end_at % BLOCK == 0
                er, ek = end_row[empty], end_at[empty] // BLOCK
                upto = np.searchsorted(r, er, "right")  # the element before an empty block, if its chunk has one
                has = (upto > 0) & (np.searchsorted(r, er) < upto)
                bounds = np.concatenate([b, [len(r)]])
                start = []
                for _, shifted in hashes:
                    inner = np.where(np.searchsorted(r, br) < b, shifted[b], 0)
                    start.append(np.concatenate([inner, np.where(has, shifted[upto], 0)]))
                items = pa.StructArray.from_arrays([pa.array(hashes[0][0]), pa.array(hashes[1][0]), pa.array(size), pa.array(last)], names=["q1", "q2", "size", "last"])
                els = pa.ListArray.from_arrays(pa.array(np.concatenate([bounds, np.full(len(er), len(r))]).astype(np.int32)), items)
                who = np.concatenate([br, er])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who)), pa.array(np.concatenate([bk, ek])), pa.array(start[0]), pa.array(start[1]), els,
                     part.column(1).take(pa.array(who)), pa.array(~ended[who])], ["conv", "k", "p1", "p2", "els", "chunk", "open"])
    return rows.mapInArrow(cut, "conv long, k long, p1 long, p2 long, els array<struct<q1:bigint,q2:bigint,size:bigint,last:boolean>>, chunk long, open boolean")


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, k, p1, p2, els of every block, with hashes of the whole conversation."""
    rows = keep(_blocks(turns, convs), "trie-blocks")
    over = F.col("open") | (F.col("chunk") > 0)  # only conversations of more than CHUNK turns
    if rows.filter(over).isEmpty():
        return rows.select("conv", "k", "p1", "p2", "els")
    end = F.element_at("els", -1)
    sums = rows.filter(F.col("open") & (F.size("els") == BLOCK)).groupBy("conv", "chunk").agg(F.max(F.struct("k", end["q1"].alias("q1"), end["q2"].alias("q2"))).alias("e"))
    upto = Window.partitionBy("conv").orderBy("chunk")  # one row in CHUNK turns
    before = sums.select("conv", (F.col("chunk") + 1).alias("chunk"), F.bit_xor("e.q1").over(upto).alias("o1"), F.bit_xor("e.q2").over(upto).alias("o2"))
    zero = F.lit(0).cast("long")
    x1, x2 = F.coalesce("o1", zero), F.coalesce("o2", zero)
    later = rows.filter(F.col("chunk") > 0).join(before, ["conv", "chunk"], "left").select(
        "conv", "k", F.col("p1").bitwiseXOR(x1).alias("p1"), F.col("p2").bitwiseXOR(x2).alias("p2"),
        F.transform("els", lambda e: F.struct(e["q1"].bitwiseXOR(x1).alias("q1"), e["q2"].bitwiseXOR(x2).alias("q2"), e["size"].alias("size"), e["last"].alias("last"))).alias("els"))
    return keep(rows.filter(F.col("chunk") == 0).select("conv", "k", "p1", "p2", "els").union(later), "trie-blocks")


def _after(rows: DataFrame) -> DataFrame:
    """Adds _rest, the sum of `cost` over the conversation's later blocks, and _leaf, that of `leaf` over all. A window takes at most RANGE
    blocks of a conversation; the sums of whole ranges are added behind."""
    part = F.floor(F.col("k") / RANGE).cast("long")
    rows = rows.withColumn("_part", part)
    inside = Window.partitionBy("conv", "_part")
    later = inside.orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    out = rows.withColumns({"_rest": F.coalesce(F.sum("cost").over(later), zero), "_leaf": F.sum("leaf").over(inside)})
    if rows.filter(F.col("_part") > 0).isEmpty():
        return out
    sums = keep(rows.groupBy("conv", "_part").agg(F.sum("cost").alias("c"), F.sum("leaf").alias("l")), "trie-ranges")
    beyond = Window.partitionBy("conv").orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    sums = sums.select("conv", "_part", F.coalesce(F.sum("c").over(beyond), zero).alias("_c"), F.sum("l").over(Window.partitionBy("conv")).alias("_l"))
    return out.join(sums, ["conv", "_part"]).withColumns({"_rest": F.col("_rest") + F.col("_c"), "_leaf": F.col("_l")}).drop("_c", "_l")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie: conv (smallest member), depth, parent, n_convs, n_children, n_leaves, saved, n_ends, ends_sha256.

    turns: conv, place (gapless from 0), d1, d2, size as of `placed`; convs: conv (distinct), turns. Conversations without turns end at the
    root; equal ones end at one node; no conversations give no nodes. saved sums, over the subtree, (members - 1) x size; ends_sha256 hashes
    the ids that end at the node, ascending and comma-joined. Only the named columns are read."""
    rows = blocks(turns, convs)
    seen = F.struct(F.size("els").alias("n"), F.element_at("els", -1)["q1"].alias("q1"), F.element_at("els", -1)["q2"].alias("q2"))
    rows = rows.withColumn("seen", F.when(F.size("els") > 0, seen).otherwise(F.struct(F.lit(0).alias("n"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))))
    starts = rows.groupBy("k", "p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("start"), F.min("seen").alias("lo"), F.max("seen").alias("hi"))
    starts = keep(starts.filter(F.col("n") > 1).select("k", "p1", "p2", "n", "start", (F.col("lo") != F.col("hi")).alias("parts")), "trie-starts")
    rows, key = rows.drop("seen"), ["k", "p1", "p2"]
    busy = F.col("n") * BUSY >= rows.count()  # members of all starts are at most the blocks, so at most BUSY starts are busy
    often = F.broadcast(starts.filter(busy))
    rows = keep(rows.join(often, key).unionByName(rows.join(often.select(*key), key, "left_anti").join(starts.filter(~busy), key, "left")), "trie-members")

    depth = F.col("k") * BLOCK + F.col("i")
    lone = rows.filter(F.col("n").isNull()).select("conv", "k", F.posexplode("els").alias("i", "e")).select(
        "conv", depth.alias("depth"), F.when(depth > 0, F.col("conv")).alias("parent"), F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("e.last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"),
        F.col("e.last").cast("long").alias("n_ends"), F.sha2(F.when(F.col("e.last"), F.col("conv").cast("string")).otherwise(""), 256).alias("ends_sha256"))

    shared = rows.filter(F.col("n").isNotNull())
    one = shared.filter(~F.col("parts") & (F.col("conv") == F.col("start"))).select("conv", "k", "n", F.posexplode("els").alias("i", "e")).select(
        "conv", "k", "i", depth.alias("depth"), "e.q1", "e.q2", F.col("n").alias("n_convs"), "e.size", "e.last", F.when(depth > 0, F.col("conv")).alias("parent"))
    before = F.when(F.col("i") > 0, F.struct(F.get("els", F.col("i") - 1)["q1"].alias("q1"), F.get("els", F.col("i") - 1)["q2"].alias("q2")))
    parting = shared.filter("parts").select("conv", "k", "start", "els", F.posexplode("els").alias("i", "e"))
    split = parting.select("conv", "k", "i", "start", depth.alias("depth"), "e.q1", "e.q2", "e.size", "e.last", before.alias("b")).groupBy(*ID).agg(
        F.min("conv").alias("conv"), F.min("k").alias("k"), F.min("i").alias("i"), F.min("start").alias("start"), F.count(F.lit(1)).alias("n_convs"),
        F.max("size").alias("size"), F.max("last").alias("last"), F.max("b").alias("b"))
    split = keep(split, "trie-split")
    above = split.select((F.col("depth") + 1).alias("_d"), F.col("q1").alias("_q1"), F.col("q2").alias("_q2"), F.col("conv").alias("_parent"))
    split = split.join(above, (F.col("depth") == F.col("_d")) & (F.col("b.q1") == F.col("_q1")) & (F.col("b.q2") == F.col("_q2")), "left").select(
        "conv", "k", "i", *ID, "n_convs", "size", "last", F.when(F.col("depth") == 0, None).when(F.col("i") == 0, F.col("start")).otherwise(F.col("_parent")).alias("parent"))
    nodes = one.unionByName(split)
    children = nodes.filter(F.col("depth") > 0).groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("c"))
    goes_on = (F.col("n_convs") == 1) & (F.col("i") == BLOCK - 1) & ~F.col("last")  # a lone tail follows
    nodes = keep(nodes.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("c", F.lit(0).cast("long")) + goes_on.cast("long"))
                 .withColumn("leaf", (goes_on | (F.col("n_children") == 0)).cast("long"))
                 .withColumn("cost", (F.col("n_convs") - 1) * F.col("size")).drop("c"), "trie-nodes")

    # what each conversation owns in a block, and deeper down
    owned = nodes.filter((F.col("leaf") > 0) | (F.col("cost") > 0)).groupBy("conv", "k").agg(
        F.sum("cost").alias("cost"), F.sum("leaf").alias("leaf"), F.collect_list(F.struct("i", "cost")).alias("costs"))  # at most BLOCK each
    zero = F.lit(0).cast("long")
    member = shared.join(owned, ["conv", "k"], "left").withColumns({"cost": F.coalesce("cost", zero), "leaf": F.coalesce("leaf", zero)})
    member = keep(_after(member.select("conv", "k", "start", "parts", "els", "cost", "leaf", "costs")).select(
        "conv", "k", "start", "parts", "els", "_rest", "_leaf", F.coalesce("costs", F.array().cast("array<struct<i:int,cost:bigint>>")).alias("costs")), "trie-members")

    def since(i: Column) -> Column:
        return F.aggregate("costs", zero, lambda total, c: total + F.when(c["i"] >= i, c["cost"]).otherwise(zero))
    same = member.filter(~F.col("parts")).groupBy("start", "k").agg(F.sum("_rest").alias("rest"), F.sum("_leaf").alias("n_leaves"), F.max(
        F.when(F.col("conv") == F.col("start"), F.struct("costs", "els"))).alias("own"))
    same = same.select("k", "rest", "n_leaves", "own.costs", F.posexplode("own.els").alias("i", "e")).select(
        depth.alias("depth"), "e.q1", "e.q2", (F.col("rest") + since(F.col("i"))).alias("saved"), "n_leaves")
    apart = member.filter("parts").select("k", "_rest", "_leaf", "costs", F.posexplode("els").alias("i", "e")).select(
        depth.alias("depth"), "e.q1", "e.q2", (F.col("_rest") + since(F.col("i"))).alias("saved"), "_leaf")
    sums = same.union(apart.groupBy(*ID).agg(F.sum("saved").alias("saved"), F.sum("_leaf").alias("n_leaves")))
    out = nodes.join(sums, ID, "left").join(_ends(member, depth), ID, "left")
    out = out.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("n_ends", zero).alias("n_ends"),
                     F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    return out.unionByName(lone)


def _ends(member: DataFrame, depth: Column) -> DataFrame:
    """depth, q1, q2, n_ends, ends_sha256 of shared nodes at which conversations end. Ids are joined in parts of at most 2 ** ENDS, which
    Spark sorts by node and part; a task feeds them one after another to the hash and holds one part."""
    at = member.filter(F.exists("els", lambda e: e["last"])).select("conv", (F.col("k") * BLOCK + F.size("els") - 1).alias("depth"), F.element_at("els", -1).alias("e"))
    parts = at.groupBy("depth", "e.q1", "e.q2", F.shiftright("conv", ENDS).alias("part")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    parts = parts.select(*ID, "part", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids")).repartition(*ID).sortWithinPartitions(*ID, "part")

    def chained(batches):
        now, n, digest = None, 0, None
        for batch in batches:
            out = []
            for d, a, b, _, count, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, a, b) != now:
                    if now is not None:
                        out.append((*now, n, digest.hexdigest()))
                    now, n, digest = (d, a, b), 0, hashlib.sha256()
                digest.update((("," if n else "") + ids).encode())
                n += count
            yield _batch(out)
        if now is not None:
            yield _batch([(*now, n, digest.hexdigest())])
    return parts.mapInArrow(chained, "depth long, q1 long, q2 long, n_ends long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], [*ID, "n_ends", "ends_sha256"])
