"""Line dedup, collocations and conversation repair: SQL, brute force, odd tables."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from compare import compare, database
from pyspark.sql import functions as F

from shopledger.llm import collocations, linededup, turnrepair
from shopledger.llm.common import ship
from shopledger.llm.queries import ORACLES, QUERIES

SMALL, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.mark.parametrize("folder", [SMALL, NEXT])
@pytest.mark.parametrize("name", ["op11_lines", "op12_collocations", "op13_turn_repair"])
def test_query_equals_sql(spark, name, folder):
    ok, message, _ = compare(spark, database(folder), name, QUERIES[name], ORACLES[name], folder)
    assert ok, message


# --- lines ---------------------------------------------------------------------------------------

BOILER = "Subscribe to our newsletter"
LONG = "\n".join(f"line {k % 700} of the long text" for k in range(20_000))
TEXTS = [
    (3, f"{BOILER}\nown words of three\n{BOILER}\n"), (5, f"  {BOILER.upper()}\t\nfive has its own\r\n\nshort"), (7, f"{BOILER}"), (8, None), (9, ""), (10, "short\nshort"),
    (11, "short\n\n " + BOILER), (12, LONG), (13, LONG), (13, LONG), (14, "twice in one document\ntwice in one document"), (None, f"{BOILER}\nonly without an id"),
    (None, "only without an id"), (15, "café café X\u0085"), (16, "café café x\u0085"), (17, "café café x"),
]


def plain_lines(rows, min_documents=2, min_chars=10):
    key = lambda line: lower(line.strip(WHITE))
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add((i is None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_documents and min(held[key(x)]) != (i is None, i or 0) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [2, 3])
def test_lines_against_brute_force(spark, most):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_id", "position", "_lines", "n_lines", "_drops", "_h1")})
    got = [tuple(r) for r in linededup.deduplicated(docs, most).collect()]
    assert sorted(got, key=repr) == plain_lines(TEXTS, most)


def test_lines_of_an_empty_table(spark):
    assert linededup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- phrases -------------------------------------------------------------------------------------


def plain_counts(rows, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, " ".join(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return f, n


def plain_collocations(rows, least, best):
    f, n = plain_counts(rows)
    many = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    out = collections.defaultdict(list)
    for (lang, phrase), a in many.items():
        words, cuts = phrase.split(" "), []
        for k in range(1, len(words)):
            l, r = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        covered = any(g == lang and b >= a and len(p.split(" ")) > len(words) and f" {phrase} " in f" {p} " for (g, p), b in many.items())
        if not covered:
            score, _, l, r = min(cuts)
            out[lang].append((-score, -a, phrase.encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:best], 1))


def phrase_rows():
    draw = random.Random(5)
    words = [*"abcdefgh", "New", "York", "café", "x y", "\U0001f600", "Z"]
    rows = []
    for k in range(300):
        text = "".join(draw.choice(words) + draw.choice([" "] * 9 + ["\t", ", ", ".", "\n", "  ", "?! "]) for _ in range(draw.choice([0, 1, 5, 90])))
        rows.append((draw.choice(["en", "de", None, ""]), text + " new york city " * (k % 4)))
    rows += [("en", None), ("fr", "ha " * 5_000), ("en", rows[7][1]), ("en", "..!\n"), (None, "a new york city hall")] + [("xx", "one long passage that stands here again and again with many words")] * 40
    return rows


@pytest.mark.parametrize("period", [1, 4, 64])
def test_collocations_against_brute_force(spark, monkeypatch, period):
    monkeypatch.setattr(collocations, "PERIOD", period)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in ("phrase", "n", "words", "chunk", "a", "rank", "f", "doc_id")}).repartition(5)
    got = [tuple(r) for r in collocations.collocations(docs, least=20, best=30).collect()]
    assert sorted(got) == plain_collocations(rows, 20, 30)


def test_every_occurrence_stands_in_one_chunk():
    draw = random.Random(1)
    for n in (1, 3, 4, 5, 60, 2000):
        codes = np.array([draw.choice([11, 22, 33, 0]) for _ in range(n)], np.uint64)
        parts = collocations.chunks(codes, 4)
        assert np.array_equal(np.concatenate([c[:-4] for c in parts]), codes)
        found = {tuple(c[i : i + 5]) for c in parts for i in range(len(c) - 4)}
        assert all(tuple(codes[i : i + 5]) in found for i in range(n - 4))


def test_words_never_share_a_code(spark, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    # under the first seed some two words have one code; the second one is used then
    tables = []
    real = collocations.parsed

    def clashing(docs, window, seed):
        tables.append(seed)
        out = real(docs, window, seed)
        if seed == 0:
            one = F.concat(F.lit(bytes(collocations.CODE)), F.lit(b"first"))
            two = F.concat(F.lit(bytes(collocations.CODE)), F.lit(b"second"))
            more = spark.range(1).select(F.lit("").alias("lang"), F.explode(F.array(one, two)).alias("chunk"), F.lit(collocations.VOCABULARY).alias("owned"), F.lit(1).cast("long").alias("n"))
            out = out.unionByName(more)
        return out

    monkeypatch.setattr(collocations, "parsed", clashing)
    got = [tuple(r) for r in collocations.collocations(docs, least=20, best=30).collect()]
    assert tables == [0, 1] and sorted(got) == plain_collocations(rows, 20, 30)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    rows = phrase_rows()
    got = [tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=20, best=30).collect()]
    assert sorted(got) == plain_collocations(rows, 20, 30)


def test_scores_beyond_64_bits(spark):
    a, b = b"a" * 8, b"b" * 8
    phrases = spark.createDataFrame([("en", a + b, 2, 3 * 10**15), ("en", a, 1, 7 * 10**16 + 1), ("en", b, 1, 3 * 10**15)], "lang string, phrase binary, words int, f long")
    totals = spark.createDataFrame([("en", 9 * 10**17 + 7)], "lang string, n long")
    r = collocations.scored(phrases, totals).collect()
    assert [(x.a, x.l, x.r, x.n, x.score) for x in r] == [(3 * 10**15, 7 * 10**16 + 1, 3 * 10**15, 9 * 10**17 + 7, 1000 * (9 * 10**17 + 7) // (7 * 10**16 + 1))]


def test_collocations_of_empty_tables(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, " \n")], "lang string, text string")).count() == 0


# --- conversations -------------------------------------------------------------------------------


def cheapest(symbols):
    """(cost, audit) by a search over all edits in order of cost, then of the audit."""
    queue, done = [(0, "", 0, 0)], set()
    best = []
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if best and cost > best[0][0]:
            break
        if at == len(symbols) and state in (0, 3):
            best.append((cost, audit))
            continue
        if (at, state, cost, audit) in done:
            continue
        done.add((at, state, cost, audit))
        follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
        for letter in "ua":
            if letter in follow:
                heapq.heappush(queue, (cost + 3, audit + "I", at, follow[letter]))
        if at < len(symbols):
            must, cut, initial = symbols[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state))
            if not must:
                if initial in follow:
                    heapq.heappush(queue, (cost + 3 * cut, audit + "K", at + 1, follow[initial]))
                for letter in "ua":
                    if letter in follow:
                        heapq.heappush(queue, (cost + 3 + 3 * cut, audit + "R", at + 1, follow[letter]))
    return min(best)


def code(must, cut, initial):
    return 0 if must else 1 + 2 * turnrepair.INITIALS.index(initial) + cut


def solved(symbols):
    vector, paid = turnrepair.swept(symbols, 0)
    codes, state = turnrepair.traced(symbols, 0, 0)
    return paid + turnrepair.vectors()[0][vector][0], turnrepair.audit([*codes, turnrepair.closing(state)])


def test_repair_of_all_short_and_many_longer_rows():
    kinds = [(True, False, "s")] + [(False, cut, i) for i in "sua?" for cut in (False, True)]
    draw = random.Random(3)
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)] + [tuple(draw.choice(kinds) for _ in range(draw.choice([4, 5, 6, 7, 8]))) for _ in range(300)]
    for rows in cases:
        assert solved(bytes(code(*r) for r in rows)) == cheapest(rows), rows


def test_block_tables_equal_single_steps():
    found, ahead, cost = turnrepair.vectors()
    to, paid = turnrepair.blocks()
    assert len(found) < 100 and to.shape == (len(found), turnrepair.SYMBOLS**turnrepair.BLOCK)
    draw = random.Random(2)
    for _ in range(500):
        v, block = draw.randrange(len(found)), bytes(draw.randrange(9) for _ in range(turnrepair.BLOCK))
        w, total = v, 0
        for x in reversed(block):
            w, total = ahead[w, x], total + cost[w, x]
        at = int(turnrepair.block_codes(block)[0])
        assert (to[v, at], paid[v, at]) == (w, total)


def told(conv, turn):
    return f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"


def plain_repair(rows):
    """All columns of every conversation, by the search above."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        groups[conv]  # every original id
        d = zlib.crc32(told(conv, turn).encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        groups[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), [], collections.Counter()
        for _, role, text in own:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            symbols.append((fault in ("blank", "duplicate"), fault == "truncated", role[:1]))
        cost, audit = cheapest(symbols)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        size = sum(c != "D" for c in audit)
        roles, lines, k = ["s"] * (size % 2) + ["u", "a"] * (size // 2), [], 0
        for c in audit:
            if c != "D":
                want = {"u": "user", "a": "assistant", "s": "system"}[roles[len(lines)]]
                lines.append(f"{own[k][1] if c == 'K' else want}:{'' if c == 'I' else own[k][2]}")
            k += c != "I"
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows():
    draw = random.Random(11)
    rows = []
    for conv in range(60):
        for turn in range(draw.choice([0, 1, 2, 5, 8])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "sys", "", None])
            rows.append((conv, draw.choice([turn, turn, turn, None, turn + 5]), role, draw.choice(["Fine.", "Why?", "cut off", "", " \t", None, "déjà vu!", "Fine.\x0b"])))
    rows += [(None, 0, "user", "Hello."), (None, None, None, None), (None, 1, "assistant", "x" * 30_000 + "."), rows[4], rows[4]]
    rows.append((77, next(t for t in range(999) if zlib.crc32(told(77, t).encode()) % 20 == 0), "user", "dropped."))
    return rows


@pytest.mark.parametrize("segment", [4, 4096])
def test_repair_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(turnrepair, "SEGMENT", segment)
    rows = conversation_rows()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("_null", "_conv", "at", "seg", "fault", "symbol", "_rank", "audit", "cost")})
    got = [tuple(r) for r in turnrepair.repaired(turns.repartition(3)).collect()]
    assert sorted(got, key=repr) == plain_repair(rows)


def test_a_conversation_of_many_segments(spark, monkeypatch):
    draw = random.Random(4)
    kinds = [(True, False, "s")] + [(False, cut, i) for i in "sua?" for cut in (False, True)]
    symbols = bytes(code(*draw.choice(kinds)) for _ in range(5_003))
    whole = solved(symbols)
    vectors, total, pieces, state = [0], 0, [symbols[i : i + 64] for i in range(0, len(symbols), 64)], 0
    for piece in reversed(pieces):
        v, paid = turnrepair.swept(piece, vectors[-1])
        vectors.append(v)
        total += paid
    told_ = []
    for piece, v in zip(pieces, reversed(vectors[:-1]), strict=True):
        codes, state = turnrepair.traced(piece, v, state)
        told_ += codes
    assert whole == (total + turnrepair.vectors()[0][vectors[-1]][0], turnrepair.audit([*told_, turnrepair.closing(state)]))


def test_repair_of_an_empty_table(spark):
    assert turnrepair.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
