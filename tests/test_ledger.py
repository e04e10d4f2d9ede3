"""Appending exactly once: retried, half-written and later batches leave one log; chains go on over batches."""
from tocsin.operators import record
from tocsin.streaming import ledger

SCHEMA = "k string, i long, v string"
LOG = SCHEMA + ", seq long, prev_hash string, hash string"


def test_plain_rows_stand_once(spark, tmp_path):
    p, mk = str(tmp_path / "log"), lambda rows: spark.createDataFrame(rows, SCHEMA)      # noqa: E731
    write = ledger.append_once(p)
    assert ledger.log(spark, p, SCHEMA).count() == 0
    for _ in range(2):
        write(mk([("a", 1, "x"), ("a", 1, "x")]), 0)
    write(mk([("b", 2, "y")]), 1)
    write(mk([("a", 1, "x"), ("a", 1, "x")]), 0)
    write(mk([]), 2)
    mk([("c", 9, "half")]).write.parquet(f"{p}/rows/batch=3")            # lost before it was entered
    assert sorted(tuple(r) for r in ledger.log(spark, p, SCHEMA).select("k", "i", "v", "batch").collect()) == [("a", 1, "x", 0), ("a", 1, "x", 0), ("b", 2, "y", 1)]
    assert {r["batch"]: r["rows"] for r in ledger.entered(spark, p).collect()} == {0: 2, 1: 1, 2: 0}


def test_chains_go_on_and_a_retry_changes_nothing(spark, tmp_path):
    p, mk = str(tmp_path / "log"), lambda rows: spark.createDataFrame(rows, SCHEMA)      # noqa: E731
    write, fields = ledger.append_chain(p, "i", ["k", "i", "v"], "k"), ["k", "i", "v"]
    batches = [[("a", 2, "x"), ("a", 1, None), ("b", 1, "z")], [("a", 3, "w")], [("c", 1, "q"), ("b", 2, "r")]]
    for n, rows in enumerate(batches):
        write(mk(rows), n)
        write(mk(rows).repartition(3), n)
    write(mk(batches[0]), 0)
    got = ledger.log(spark, p, LOG)
    assert got.count() == 6
    assert all(r["first_bad"] is None for r in record.verify(got, fields, by=("k",)).collect())
    whole = record.chain(mk([r for b in batches for r in b]), "i", fields, by=("k",))
    key = lambda df: sorted((r["k"], r["i"], r["seq"], r["prev_hash"], r["hash"]) for r in df.collect())      # noqa: E731
    assert key(got) == key(whole)
