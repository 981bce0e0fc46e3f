"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import numpy as np
import public_tokenizers as P
import pytest
from brute import base_facts, components, words
from pyspark.sql import functions as F

import corpus_pipeline
from shopledger.llm import chat, fertility, idfiles, mainsegment, mixture, onebit, prefixtree, secretscan, sharding, viterbi
from shopledger.llm.common import ship, table

SMALL = "/root/testdata/sf0.001"
PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))
PLAIN = "the quick brown fox jumps over the lazy dog while seven other animals look on from the old bridge near here today"
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, LONG, "en", "a"), (5, PLAIN, "en", "b"), (5, PLAIN, "en", "b"), (6, PLAIN, "en", "b"),
    (7, "short one", "xx-weird", ""), (8, "short one", "de", "tests/é"), (9, PLAIN + ' token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end', "fr", None), (10, "x" * 50_000, "fr", "z"),
]
EXTRA = ["_null", "_source", "_rank", "_n", "_part", "_p", "_h", "n", "sig", "facts", "ids", "shard", "slot", "size", "copies", "comp", "_apart", "_values", "label", "html"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("taken") for c in EXTRA})


def test_mixture(docs):
    out = mixture.mixed(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in out) == sorted((i, len(words(t))) for i, t, _, _ in ROWS)
    assert all(r.taken <= 2 * r["size"] and (r.target is not None) for r in out)
    assert mixture.mixed(docs.limit(0)).count() == 0
    assert all(r.target == 0 == r.taken for r in mixture.mixed(docs.filter("doc_id < 4")).collect())


def test_sentencepiece(docs):
    back = viterbi.decode(viterbi.encode(docs, PIECES), PIECES, out="back").collect()
    assert sorted((r.doc_id, r.back) for r in back) == sorted((i, t or "") for i, t, _, _ in ROWS)
    assert viterbi.encode(docs.limit(0), PIECES).count() == 0


def test_join(docs):
    want = components([(i, t) for i, t, _, _ in ROWS])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in prefixtree.joined(docs).collect()]
    assert sorted(got) == sorted((i, *want[i]) for i, *_ in ROWS)
    assert prefixtree.joined(docs.limit(0)).count() == 0
    keyless = prefixtree.joined(docs.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))).filter("doc_id is null").collect()
    assert len(keyless) == 6 and all(r.component_id is None for r in keyless)


def test_fertility(docs):
    rows = docs.withColumn("own facts", fertility.facts(F.col("text"), PIECES)).cache()
    out = fertility.judged(rows, "own facts")
    assert set(rows.columns) < set(out.columns) and out.count() == len(ROWS)
    for r in out.collect():
        f = r["own facts"]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, r[fertility.BASE_FAILED]) == base_facts(r.text)
    assert fertility.judged(rows.limit(0), "own facts").count() == 0


def test_token_ids(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    want = sorted((i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, _, _ in ROWS)
    got = sorted(idfiles.written_ids(spark, docs, WORDS).collect(), key=lambda r: (r.doc_id, r.start))
    assert [(r.doc_id, bytes(r.ids_bytes)) for r in got] == want
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert idfiles.written_ids(spark, docs.limit(0), WORDS).count() == 0
    keyless = idfiles.written_ids(spark, docs.withColumn("doc_id", F.lit(None).cast("long")), WORDS).collect()
    assert len(keyless) == len(ROWS) and all(r.doc_id is None for r in keyless)


def test_main_text(spark, docs):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<article>" + "<p>a b" * 20_000), (None, "<article><p>x y z</article>"), (None, "<article><p>x y z</article>")], "page_id long, html string").withColumn("text", F.lit("taken"))
    out = pages.withColumn("found", mainsegment.main_text(F.col("html"), mainsegment.fit(pages))).collect()
    assert [r.found for r in out] == ["", "", "\n\n".join(["a b"] * 20_000), "x y z", "x y z"]


def test_sharding(docs):
    out = sharding.sharded(docs, 4).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, *_ in ROWS)
    counts = [sum(r.shard == k for r in out) for k in range(4)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in out if r.shard == k) == list(range(counts[k])) for k in range(4))
    assert {r.shard for r in sharding.sharded(docs.limit(2), 40).collect()} <= set(range(40))
    assert sharding.sharded(docs.limit(0), 4).count() == 0


def test_shards_hold_every_row_once(spark, docs, tmp_path):
    own = docs.drop("shard", "slot").unionByName(docs.drop("shard", "slot").limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.drop("shard", "slot").filter("doc_id = 5")).cache()
    places = sharding.sharded(own, 4)
    sharding.write(own, places, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    want = sorted(map(str, own.collect()))
    assert sorted(map(str, back.select(*own.columns).collect())) == want
    assert sorted((r.shard, r.slot, r.doc_id) for r in back.collect() if r.doc_id is not None) == sorted((r.shard, r.slot, r.doc_id) for r in places.collect() if r.doc_id is not None)
    held = {}
    for r in back.collect():
        held.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in held.values()) and set(held) == {0, 1, 2, 3}


def test_secrets(spark, docs):
    model = secretscan.fit(secretscan.practice(spark))
    out = secretscan.masked(docs, model)
    assert out.columns == docs.columns
    told = {(r.doc_id, r.text) for r in out.collect()}
    assert told == {(i, t if i != 9 else PLAIN + f' token = "{secretscan.MARK}" end') for i, t, _, _ in ROWS}
    assert secretscan.masked(docs.limit(0), model).count() == 0 == secretscan.findings(docs.limit(0), ["doc_id"]).count()


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, None, None), (None, 0, "assistant", LONG), (2, None, "assistant", "")], "conv_id long, turn long, role string, text string").withColumn("node", F.lit("taken"))
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chat.chain(turns))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in out.items()} == {1: (3, 0), None: (1, len(LONG)), 2: (1, 0)}
    assert chat.formatted(chat.chain(turns.limit(0))).count() == 0


def test_search_with_other_columns(spark):
    v = spark.createDataFrame([(k % 7, [float(k % 3), 1.0]) for k in range(30)], "vec_id long, embedding array<float>").withColumns({c: F.lit("taken") for c in ("id", "vector", "raw", "score")})
    got = onebit.nearest(v, F.col("id") == 0, 20).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 21)) and all(r.vec_id != 0 for r in got)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, docs, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, SMALL)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() >= 2
    assert run(spark, docs.limit(0), SMALL).count() == 0
