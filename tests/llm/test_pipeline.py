"""The pipeline's stages against brute force, each on its own input, and the registered queries against their SQL."""
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import compare, duck
from tests.llm.test_operators import leaks_by_hand, near_by_hand
from tocsin.llm import lines, queries
from tocsin.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    msg, _, _, ok = compare(spark, duck(SF), SF, name, queries.QUERIES[name], ORACLES[name])
    assert ok, msg


def test_stages_do_what_they_say(spark, tmp_path):
    docs, steps = spark.read.parquet(f"{SF}/documents.parquet"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{name}")
        steps[name] = (before.collect(), spark.read.parquet(f"{tmp_path}/{name}"))
        before = steps[name][1]
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == docs.columns
    rows, out = steps["quality classifier"]
    field = lines.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in lines.scored(docs, field, ["doc_id"]).collect() if r["score"] >= 0.3}
    assert {r["doc_id"] for r in out.collect()} == good
    rows, out = steps["near copies"]
    assert {r["doc_id"] for r in out.collect()} == {i for i, n, c in near_by_hand(rows) if n == 0 or i == c}
    rows, out = steps["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in leaks_by_hand(rows, items) if not r[-1]}
    rows, out = steps["mixture"]
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert sum(map(words, out.collect())) == pytest.approx(1.5 * sum(map(words, rows)), rel=0.1)
    assert max(Counter(r["doc_id"] for r in out.collect()).values()) <= 2
    rows, out = steps["sharding"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in rows)
    n = Counter(r["shard"] for r in out.collect())
    assert max(n.values()) - min(n.values()) <= 1


def test_every_operator_is_registered():
    names = [k for k in entry.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
