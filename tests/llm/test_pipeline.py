"""The pipeline against a plain version of its decisions, stage by stage."""

import re

from brute import base_facts, components, words
from pyspark.sql import functions as F

import corpus_pipeline
from shopledger.llm import secretscan
from shopledger.llm.common import table, written

SMALL, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FORM = re.compile(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}|token = \"[0-9a-f]{40}\"")


def test_stages_take_effect(spark):
    docs = table(spark, NEXT, "documents")
    good = {r.doc_id for r in table(spark, NEXT, "labels").collect() if r.quality == 1}
    kept, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        docs = written(stage(spark, docs, NEXT), name)
        assert docs.columns == columns
        rows = docs.collect()
        kept = {r.doc_id: r for r in rows}
        if name == "quality":
            passed = {i for i, r in before.items() if not base_facts(r.text)[5]}
            assert set(kept) <= passed and len(passed & good - set(kept)) <= 0.02 * len(passed & good)
        elif name == "near_copies":
            assert set(kept) == {i for i, (_, c) in components([(i, r.text) for i, r in before.items()]).items() if i == c}
        elif name == "secret_scan":
            assert set(kept) == set(before)
            assert all(not FORM.search(r.text) and r.n_chars == len(r.text) for r in rows)
            assert any(secretscan.MARK in r.text for r in rows)
            assert all(r.text == before[r.doc_id].text for r in rows if secretscan.MARK not in r.text)
        else:
            whole, taken = sum(len(words(r.text)) for r in before.values()), sum(len(words(r.text)) for r in rows)
            assert abs(taken - 1.5 * whole) <= 0.05 * whole and max(sum(x.doc_id == i for x in rows) for i in kept) <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, NEXT).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in rows) and all(r.restored for r in out)


def test_run_repeats_itself(spark):
    one, two = (sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", F.col("n_tokens")).collect()) for _ in range(2))
    assert one == two and one
