"""Quality rules, SentencePiece Viterbi and token-id files against plain versions."""

import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from brute import base_facts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopledger.llm import fertility, idfiles, viterbi
from shopledger.llm.common import ship, table
from shopledger.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "  a  b \n\n c", "ab c \x0b\x0cx", "İß ſ ŉ Σας", "a" * 3000, "漢字 😀 <0x0A> é é", "'tis it's 12.5, ...", "<|endoftext|>.", "x\ty\r\nz", "\u0000a"]


def test_base_rules_equal_plain_version(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    for r in QUERIES["op5_fertility"](spark, SMALL).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_facts(texts[r.doc_id])
        assert r.kept is False if r.base_failed else r.kept is not None


def test_fertility_measures(spark):
    from sentencepiece import SentencePieceProcessor

    model, meter = SentencePieceProcessor(model_file=PIECES), fertility.Meter(PIECES)
    for text in [*ODD, "Plain words, and 漢字."]:
        got = meter.measure([text])[0]
        assert (*got[:5], got[0] < 20 or 100 * got[4] > 30 * got[0]) == base_facts(text)
        ids = [i for w in text.encode().split() for i in model.encode(w.decode())]
        assert got[5] == len(ids)
        if ids:
            share = np.unique(ids, return_counts=True)[1] / len(ids)
            assert got[7] == pytest.approx(sum(model.is_byte(i) for i in ids) / len(ids))
            assert got[8] == pytest.approx(-(share * np.log2(share)).sum() / max(1, np.log2(max(2, len(ids)))))


def test_bands_catch_foreign_junk_and_keep_clean_rows(spark):
    ship(spark)
    # rows labelled as junk are not among the clean ones
    bad = table(spark, SMALL, "labels").filter("quality = 0").select("doc_id")
    clean = table(spark, SMALL, "documents").filter("lang = 'en' and n_chars between 300 and 3000").join(bad, "doc_id", "left_anti")
    junk = spark.createDataFrame([(-1, " ".join(f"䷀{chr(0x4DC0 + k % 60)}漢{k}" for k in range(100)), "en")], "doc_id long, text string, lang string")
    rows = clean.select("doc_id", "text", "lang").union(junk).withColumn("facts", fertility.facts(F.col("text"), PIECES)).cache()
    out = {r.doc_id: r for r in fertility.judged(rows, "facts").collect()}
    assert not out[-1][fertility.KEPT]
    good = [r for r in out.values() if r.doc_id >= 0 and not r[fertility.BASE_FAILED]]
    assert sum(r[fertility.KEPT] for r in good) >= 0.97 * len(good)


def best_sum(pieces, text):
    """Largest score sum over all segmentations, tried one by one."""
    plain = {p: s for p, (_, _, s) in ((k, pieces.automaton.get(k)) for k in pieces.automaton.keys())}
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            s = plain.get(text[start:end], pieces.unknown_score if end - start == 1 else -np.inf)
            best[end] = max(best[end], best[start] + s)
    return best[-1], plain


@pytest.fixture(scope="module")
def pieces():
    return viterbi.Pieces(PIECES)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aeinrstTh ▁\né漢0", max_size=25))
def test_segment_has_the_best_score(text):
    codec = viterbi.codec(PIECES)
    escaped = (viterbi.MARK + text.replace(" ", viterbi.MARK)) if text else ""
    ids = np.frombuffer(next(codec.encode([text])), "<i4").tolist()
    best, plain = best_sum(codec.pieces, escaped)
    names = {i: k for k in plain for i in [codec.pieces.automaton.get(k)[0]]}
    total, waiting = 0.0, 0
    for i in ids:
        if i in names:
            total += plain[names[i]]
        elif not waiting:  # the first byte of a character
            byte = viterbi.piece_bytes(PIECES)[i][0]
            waiting = 0 if byte < 128 else 1 if byte < 224 else 2 if byte < 240 else 3
            total += codec.pieces.unknown_score
        else:
            waiting -= 1
    assert total == best
    assert viterbi.decoded(ids, viterbi.piece_bytes(PIECES)) == text.replace(viterbi.MARK, " ")


def test_encoding_restores_odd_texts(spark):
    ship(spark)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*ODD, None])], "doc_id long, text string")
    out = {r.doc_id: r for r in viterbi.decode(viterbi.encode(rows, PIECES), PIECES, out="back").collect()}
    assert all(out[k].back == (t or "") for k, t in enumerate([*ODD, None]))
    assert all(r.restored for r in QUERIES["op3_sentencepiece"](spark, SMALL).collect())


def whole_text_ids(texts):
    from tokenizers import Tokenizer

    return [np.array([*e.ids, 2], "<u4") for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAéÉßſİΣσς.,' \ń̈<|>endoftext1²J漢\t", max_size=30))
def test_word_by_word_ids_equal_the_library(text):
    assert list(idfiles.word_encoder(WORDS, 2)([text])) == [x.tobytes() for x in whole_text_ids([text])]


def test_files_hold_the_ids_in_order(spark):
    docs = sorted(table(spark, SMALL, "documents").collect(), key=lambda r: r.doc_id)
    ids = whole_text_ids([r.text for r in docs])
    got = sorted(QUERIES["op6_token_ids"](spark, SMALL).collect(), key=lambda r: r.doc_id)
    at = 0
    for d, x, r in zip(docs, ids, got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)


def test_one_document_from_several_files(spark, tmp_path):
    ship(spark)
    docs, folder = table(spark, SMALL, "documents"), f"file://{tmp_path}/ids"
    manifest = idfiles.write(docs, folder, WORDS, rows_per_file=60)
    listed = manifest.orderBy("shard").collect()
    assert len(listed) > 1 and sum(r.n_docs for r in listed) == docs.count()
    assert [r.start for r in listed] == [sum(x.n_tokens for x in listed[:k]) for k in range(len(listed))]
    first = docs.orderBy("doc_id").first()
    assert idfiles.read_one(listed[0].path, folder, 0).tolist() == whole_text_ids([first.text])[0].tolist()
    with open(f"{tmp_path}/ids/dictionary.zdict", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        idfiles.read_one(listed[0].path, folder, 0)


def test_bands_decide_on_short_long_and_copied_texts(spark):
    ship(spark)
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, folder, "documents").collect()]
    sane = {i for i, t, _ in docs if not base_facts(t)[5]}
    of = lambda quality, lang="en": [t for i, t, x in docs if i in sane and labels.get(i) == quality and x == lang]
    junk, clean = of(0), of(1)
    long_junk, long_clean = " ".join(junk), " ".join(clean[:40])
    few = [(-1, long_junk, "en"), (-2, long_clean, "en"), (-3, " ".join(clean[0].split()[:24]), "en"), (-4, clean[1], "pl"), (-5, junk[0], "pl")]
    out = {}
    for name, more in (("once", []), ("copied", [(-10 - k, junk[1], "en") for k in range(1_500)])):
        rows = spark.createDataFrame(docs + few + more, "doc_id long, text string, lang string").withColumn("facts", fertility.facts(F.col("text"), PIECES)).cache()
        out[name] = {r.doc_id: r[fertility.KEPT] for r in fertility.judged(rows, "facts").select("doc_id", fertility.KEPT).collect()}
    kept = out["once"]
    bad, good = [i for i in sane if labels.get(i) == 0], [i for i in sane if labels.get(i) == 1]
    assert sum(not kept[i] for i in bad) >= 0.7 * len(bad) and sum(kept[i] for i in good) >= 0.98 * len(good)
    assert not kept[-1] and kept[-2] and kept[-3]
    # a language of one or two texts is judged by its script
    assert kept[-4] and not kept[-5]
    # copies change no verdict
    assert {i: k for i, k in out["copied"].items() if i > -10} == kept and not out["copied"][-10]


@pytest.mark.parametrize("piece", ['<div class="a ', "<a x ", "<![CDATA[ ", "<p 'x", "<!-- ", "<script ", "<", "</", '<b a="', "<!x "])
def test_malformed_pages_take_linear_time(piece):
    from shopledger.llm import mainsegment

    def seconds(times):
        page = piece * times
        began = time.perf_counter()
        mainsegment.tokens(page)
        return time.perf_counter() - began

    # fifty times the page; a square would be 2,500 times the seconds
    assert seconds(100_000) < 200 * max(seconds(2_000), 0.002)


def test_tags_end_outside_quotes():
    from shopledger.llm.mainsegment import tokens

    names = [t[1] if t[0] == "tag" else t[0] for t in tokens("a<p title='>' x=\">\">b</p><em>e</em><!-- > --><script>x</p></script>f<style>g")]
    assert names == ["text", "p", "text", "p", "em", "text", "em", "gap", "text", "gap"]
    assert tokens("<p") == [("text", "<p")] and tokens("x < y") == [("text", "x < y")] and tokens("") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aZé'st.,!?$%&*()|#-_ \n1ß…\"<>", max_size=24))
def test_symbols_behind_words_are_pieces_of_their_own(text):
    assert list(idfiles.word_encoder(WORDS, 2)([text])) == [x.tobytes() for x in whole_text_ids([text])]


def test_another_vocabulary_is_run_over_whole_texts():
    from tokenizers import Tokenizer

    path, texts = P.path("byte_bpe_50k.json"), ["Hello, World\n two  spaces", "it's $$$", None]
    encoder = idfiles.WordEncoder(path, 2)
    want = [np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    assert not encoder.by_word and list(encoder(texts)) == want


def test_the_dictionary_is_trained_on_any_part_of_documents(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(idfiles, "TRAINING_IDS", 50)
    docs = table(spark, SMALL, "documents")
    one, two = (idfiles.train_dictionary(docs.repartition(k), WORDS, 2, rows=100, size=2_000) for k in (1, 5))
    assert one == two and len(one) > 0
    assert idfiles.train_dictionary(docs.limit(0), WORDS, 2) == b""
