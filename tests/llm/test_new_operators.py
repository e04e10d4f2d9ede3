"""Secret scans, spelling variants and the conversation trie against brute force, on odd rows, empty tables and clashing columns."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import rows_of
from tocsin.llm import counts, entropy, queries, tries, variants
from tocsin.llm.words import Texts

TURNS = "conv_id long, turn long, role string, text string"


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_by_hand(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{entropy.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def bits(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def windows_by_hand(text, allow=entropy.ALLOWED, exact=()):
    """Every window of every class on its own, without counts that are carried on."""
    text, known, spans = text or "", [tuple(map(int, b.split(":")[1:])) for b in base_by_hand(text)], []
    for c in re.finditer("[A-Za-z0-9+/_.=-]{20,}", text):
        covered = [False] * len(c[0])
        for kind in entropy.CLASSES:
            for m in re.finditer("[" + re.escape(kind.alphabet.decode()) + "]+", c[0]):
                for i in range(m.start(), m.end() - kind.window + 1):
                    w = c[0][i:i + kind.window]
                    if bits(w) >= kind.least - 1e-9 and sum(x.isdigit() for x in w) >= 2 and sum(x.isalpha() for x in w) >= 2:
                        covered[i:i + kind.window] = [True] * kind.window
        harmless = [m.span() for p in allow for m in re.finditer(p.decode(), c[0])]
        for m in re.finditer("1+", "".join("01"[x] for x in covered)):
            s, e = m.start() + c.start(), m.end() + c.start()
            if not any(a <= s and e <= b for a, b in known) and c[0] not in exact and not any(a < m.end() and m.start() < b for a, b in harmless):
                spans.append(f"entropy:{s}:{e}")
    return spans


@pytest.fixture(scope="module")
def leaky(spark):
    r = random.Random(8)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    mixed, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    texts = [None, "", "token=abc", "TOKEN : 'abcdef", "é password=\"ab.cd-ef\" é", "api_key=x api-key=abcdefg apikey = abcdefg", "AKIA", "AKIA" + pick("ABC1", 16),
             "é" * 30 + pick(hexes, 24) + "g" + pick(hexes, 23), "ghp_" + pick(mixed, 36), "see " + pick(mixed, 400) + ".", pick(hexes.upper(), 40),
             "id 123e4567-e89b-12d3-a456-426614174000 here", "sha256-" + pick(mixed, 44), "https://www.a.b/" + "/".join(["path", "to", "things"]) * 3,
             "AKIAEXAMPLE" + pick("ABCD", 20), pick(mixed, 40) + "example", "aaaa1111" * 20, "toKen=secret=token:abcdef123", "toſken = abcdefgh", "secret" + " " * 500 + "= abcdefgh",
             "Donaudampfschifffahrtsgesellschaftskapitänsmütze2", pick(mixed, 30) + "\n" + pick(mixed, 30), "known/" + "A1b2C3d4E5f6G7h8I9j0" * 2]
    texts += [" ".join(pick(r.choice([mixed, hexes, "ab", "ab1"]), r.randint(1, 60)) for _ in range(30)) for _ in range(40)]
    return spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").selectExpr("*", "1 AS spans", "'x' AS kind", "2 AS start")


def test_spans_are_those_found_by_hand(leaky):
    got = rows_of(entropy.scanned(leaky, ["doc_id", "text"]).withColumn("spans", entropy.listed(F.col("spans"))), "doc_id", "text", "spans")
    order = {k: i for i, k in enumerate(entropy.KINDS)}

    def key(span):
        k, s, _ = span.split(":")
        return int(s), order[k]
    want = sorted(((r["doc_id"], r["text"], ",".join(sorted(base_by_hand(r["text"]) + windows_by_hand(r["text"]), key=key))) for r in leaky.collect()), key=repr)
    assert got == want
    assert sum("entropy" in w[2] for w in want) > 20


def test_allow_list_and_exact_strings_drop_only_the_methods_spans(leaky):
    known = "known/" + "A1b2C3d4E5f6G7h8I9j0" * 2
    with_it = entropy.scanned(leaky, ["text"]).filter(F.col("text") == known).select(entropy.listed(F.col("spans"))).first()[0]
    without = entropy.scanned(leaky, ["text"], exact=[known]).filter(F.col("text") == known).select(entropy.listed(F.col("spans"))).first()[0]
    assert "entropy" in with_it and without == ""
    n = lambda allow: entropy.scanned(leaky, ["text"], allow=allow).select(F.sum(F.size(entropy.of_kind(F.col("spans"), "assign", "access", "hex")))).first()[0]
    assert n((rb".",)) == n(()) > 0


def test_window_entropy_does_not_drift():
    r = random.Random(2)
    for w in (1, 2, 5, 20):
        parts = [bytes(r.choice(b"abc01") for _ in range(r.randint(1, 80))) for _ in range(6)]
        h = iter(entropy.entropies(np.frombuffer(b"".join(parts), np.uint8).astype(np.int64), np.repeat(np.arange(6), [len(p) for p in parts]), w))
        for p in parts:
            for j in range(len(p)):
                assert next(h) == pytest.approx(bits(p[j + 1 - w:j + 1]) if j + 1 >= w else -1, abs=1e-7)
    long = np.frombuffer(bytes(r.choice(b"abcdef0123") for _ in range(300_000)), np.uint8).astype(np.int64)
    h = entropy.entropies(long, np.zeros(len(long), np.int64), 20)
    assert h[-1] == pytest.approx(bits(bytes(long[-20:].astype(np.uint8))), abs=1e-7)
    assert len(entropy.entropies(np.zeros(0, np.int64), np.zeros(0, np.int64), 20)) == 0


def test_scan_of_nothing_and_of_odd_rows(odd, none):
    assert entropy.scanned(none, ["doc_id"]).count() == 0
    assert entropy.scanned(odd, odd.columns).count() == odd.count()


# spelling variants

def words_by_hand(rows):
    n = Counter()
    for i, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda x: x[0].lower(), m[0])
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(rows):
    n = words_by_hand(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.fixture(scope="module")
def misspelt(spark):
    r = random.Random(6)
    stems = ["".join(r.choice("abeénst") for _ in range(r.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ßßßßß", "ÀÀÀÀÀ", "àààààà"]
    rows = [(None, "Weder WEDER weder Wéder"), (1, None), (2, ""), (3, ("é" * 9000 + " ") * 3 + ("é" * 9001 + " ") * 7), (4, "é" * 9000), (5, "é" * 9000 + "x"), (5, "é" * 9000 + "x"), (6, "é" * 9000 + "x"),
            (7, "non-ASCII Ā endsĀwords ×÷×÷× " * 4), (8, "zwölf " * 40 + "zwolf " * 15 + "zwolg " * 5)]
    for i in range(60):
        text = []
        for _ in range(120):
            w = stems[min(int(r.expovariate(0.08)), len(stems) - 1)]
            k = r.randrange(len(w))
            text.append(r.choice([w, w, w, w.upper(), w[:k] + w[k + 1:], w[:k] + r.choice("abeé") + w[k + 1:], w[:k] + r.choice("aé") + w[k:]]))
        rows.append((10 + i, r.choice([" ", ", ", "-"]).join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS word", "3 AS n", "1 AS id", "2 AS _sig")


def test_variants_are_those_found_by_hand(misspelt):
    want = variants_by_hand([(r["doc_id"], r["text"]) for r in misspelt.collect()])
    assert rows_of(variants.variants(misspelt), *COLUMNS) == want
    assert any(f and r != f for _, f, r, *_ in want) and any(len(w[0]) > 8000 and w[4] for w in want)


def test_variants_of_nothing_and_of_odd_rows(odd, none):
    assert variants.variants(none).count() == 0
    assert rows_of(variants.variants(odd), *COLUMNS) == variants_by_hand([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_no_join_of_words_is_broadcast(spark, misspelt, monkeypatch):
    # before: 28 rows for every word were broadcast, as Spark took the size of the words in their files for them
    plans, write = [], variants.keep
    monkeypatch.setattr(variants, "keep", lambda df, name: plans.append(df) or write(df, name))
    plans.append(variants.variants(misspelt))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_near_words_always_share_a_signature():
    r = random.Random(1)
    for _ in range(300):
        w = "".join(r.choice("abcdeé") for _ in range(r.randint(5, 12)))
        k = r.randrange(len(w))
        other, less = w[:k] + r.choice("abcxyz") + w[k + 1:], w[:k] + w[k + 1:]
        a, b = variants.signatures([w, other], 2)
        assert (a == b).any()
        a, b = variants.signatures([w, less], 1)
        assert (a == b).any()


def test_checksums_are_those_of_zlib():
    r = random.Random(3)
    parts = [bytes(r.randrange(256) for _ in range(n)) for n in [1, 2, 3, 63, 64, 65, 400] * 5]
    at = np.cumsum([0] + [len(p) for p in parts])
    state = np.array([zlib.crc32(str(i).encode()) for i in range(len(parts))], np.uint32)
    got = variants.checksums(np.frombuffer(b"".join(parts), np.uint8), at[:-1], at[1:], state)
    assert got.tolist() == [zlib.crc32(str(i).encode() + p) for i, p in enumerate(parts)]
    none = Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool))
    assert len(variants.tokens([], none)[0]) == 0


# conversation trie

def trie_by_hand(rows):
    own, node, kids, leaves, saved = defaultdict(list), defaultdict(list), Counter(), Counter(), Counter()
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{role}\0{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            node[tuple(whole[c][:d])].append(c)
    for k in node:
        kids[k[:-1] if k else None] += 1
    for k, m in node.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(((min(m), len(k), min(node[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))).encode()).hexdigest()) for k, m in node.items()), key=repr)


def trie_of(df):
    return rows_of(tries.trie(*tries.rebuilt(tries.placed(tries.hashed(df)))), "conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")


@pytest.fixture(scope="module")
def talks(spark):
    r, rows = random.Random(4), []
    for c in range(-150, 450):
        if r.random() > 0.2:
            for t in range(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 30])):
                rows.append((c if c % 7 else c // 70 * 70, r.choice([t, t, None]), r.choice(["u", "a", None]), r.choice(["x", "yy", "", "zzé", None]) if r.random() < .2 else "same"))
    rows += [(c, i, "u", "k") for c in (8, 9, 109) for i in range(40)] + [(None, 1, "u", "n"), (2 ** 60, 1, "u", "k")]
    return spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS conv", "2 AS size", "'z' AS place", "3 AS k")


@pytest.mark.parametrize("chunk, blocks", [(1024, 256), (8, 2)])
def test_trie_is_that_built_by_hand(talks, monkeypatch, chunk, blocks):
    monkeypatch.setattr(tries, "CHUNK", chunk)
    monkeypatch.setattr(tries, "RANGE", blocks)
    monkeypatch.setattr(tries, "ENDS", 2)
    want = trie_by_hand([tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()])
    assert trie_of(talks) == want
    assert trie_of(talks.repartition(7)) == want


def test_trie_of_one_and_of_none(spark):
    assert trie_of(spark.createDataFrame([(5, None, None, None)], TURNS)) == trie_by_hand([(5, None, None, None)])
    assert trie_of(spark.createDataFrame([], TURNS)) == []
    assert trie_of(spark.createDataFrame([(None, 1, "u", "a")], TURNS)) == []


def test_places_go_on_over_ranges(spark):
    df = spark.range(5000).selectExpr("id % 3 AS conv_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS turn", "'u' AS role", "cast(id * 7919 % 5000 AS string) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = tries.placed(tries.hashed(df)).groupBy("conv").agg(F.count("*"), F.min("place"), F.max("place"), F.countDistinct("place")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r[1] == r[3] + 1 == r[4] and r[2] == 0 for r in got)


def test_digest_columns_of_the_scan(spark):
    sf = "/root/testdata/sf0.001"
    got = rows_of(queries.op11_entropy(spark, sf), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = base_by_hand(r["text"])
        kinds = Counter(s.split(":")[0] for s in spans)
        added = sorted(spans + windows_by_hand(r["text"]), key=lambda s: (int(s.split(":")[1]), entropy.KINDS.index(s.split(":")[0])))
        want.append((r["doc_id"], kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(added)))
    assert got == sorted(want, key=repr)


# token counts

def test_a_compacted_store_knows_its_batches(spark, odd, tmp_path):
    one = counts.VERSIONS["words/1"](F.col("text"))
    store = counts.Rollup(spark, f"file://{tmp_path}/store")
    for name in ("a", "b"):
        store.commit(name, counts.inserts(odd, "words/1", one))
    small = store.compact(f"file://{tmp_path}/small")
    small = small.compact(f"file://{tmp_path}/smaller")
    before = rows_of(small.totals(), "source", "lang", "version", "n_docs", "n_tokens")
    small.commit("b", counts.inserts(odd, "words/1", one))  # a late retry
    assert rows_of(small.totals(), "source", "lang", "version", "n_docs", "n_tokens") == before
    small.commit("c", counts.inserts(odd, "words/1", one))
    assert sum(r["n_docs"] for r in small.totals().collect()) == 3 * odd.count()
    assert {r["batch"] for r in small.committed().collect()} == {"a", "b", "c"}


def test_deleted_copies_are_those_found_by_hand(odd, none):
    rows = odd.select("doc_id", "source", "lang", F.md5("text").alias("same"), counts.VERSIONS["words/2"](F.col("text")).alias("two"))
    known = [r for r in rows.collect() if r["same"] is not None and r["doc_id"] is not None]
    first, want = {}, defaultdict(lambda: [0, 0])
    for r in known:
        first[r["same"]] = min(first.get(r["same"], r["doc_id"]), r["doc_id"])
    for r in known:
        if r["doc_id"] != first[r["same"]]:
            want[r["source"], r["lang"]][0] -= 1
            want[r["source"], r["lang"]][1] -= r["two"]
    got = defaultdict(lambda: [0, 0])
    for r in counts.copies(rows, "words/2").collect():
        got[r["source"], r["lang"]][0] += r["n_docs"]
        got[r["source"], r["lang"]][1] += r["n_tokens"]
    assert dict(got) == dict(want) and want
    assert counts.copies(none.select("doc_id", "source", "lang", F.md5("text").alias("same"), F.lit(1).alias("two")), "words/2").count() == 0
