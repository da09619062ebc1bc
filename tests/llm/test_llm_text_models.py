"""Byte-level BPE against the library, phrases against brute force, repairs against a search in order of cost."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from boxmill.llm import bpe, phrases, queries, repair
from boxmill.llm.sql import SQL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DATA = "/root/testdata/sf0.01"
given_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(None, PATH), special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.of(bpe.read_ranks(None, PATH))


def ids_of(vocabulary, text: str) -> list[int]:
    known = bpe.Encoded(vocabulary)
    return [i for some in bpe._pieces(bpe.regex.compile(public_tokenizers.PATTERN), text) for x in some for i in np.frombuffer(known[x], "<u4").tolist()]


def test_perfect_hash(vocabulary):
    table = vocabulary.table
    assert sorted(table.find(key) for key in table.keys) == list(range(len(table.keys)))
    assert table.find(b"no such token at all") == -1 and table.find(b"") == -1
    for keys in ([], [b"a"], [b"a", b"b", b"c"]):
        small = bpe.PerfectHash.of(keys)
        assert sorted(small.keys) == sorted(keys) and all(small.keys[small.find(k)] == k for k in keys)


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoding_equals_the_library(vocabulary, library, text):
    assert ids_of(vocabulary, text) == library.encode_ordinary(text)


def test_odd_texts_encode_like_the_library(vocabulary, library):
    for text in ("<|endoftext|> it's", "ab" * 5000, " " * 3000 + "x", "\n\n \t\r\n", "日本語" * 500, "á‍😀", "1234567890" * 100, "x" * 70):
        assert ids_of(vocabulary, text) == library.encode_ordinary(text)


def test_long_texts_are_split_alike(vocabulary, library, monkeypatch):
    text = "It's a text, of 12 words  and\n some more.  " * 50
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    assert ids_of(vocabulary, text) == library.encode_ordinary(text)


def test_bpe_columns(spark, docs, doc_rows, library):
    coder = bpe.Bpe(spark, PATH)
    out = bpe.decode_texts(bpe.encode_texts(docs.withColumn("IDS", F.lit(1)).withColumn("a.b", F.lit(2)), coder), coder).collect()
    assert len(out) == len(doc_rows)
    want = Counter((d, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t, *_ in doc_rows)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out) == want and out[0]["a.b"] == 2
    assert bpe.encode_texts(docs.limit(0), coder).count() == 0
    with pytest.raises(ValueError):
        bpe.Vocabulary.of({b"a": 0})


def phrases_brute(rows, orders=5, least=100, covered=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, orders + 1):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        able = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in able.items():
            if any(len(q) > len(p) and 100 * c >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in able.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def text_rows(n: int = 300) -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for k in range(n):
        ws = [rng.choice(["New York", "new  York city", "der", "é É", "a\tb", "the the the", "x" * rng.randrange(1, 4), f"w{rng.randrange(40)}"]) + rng.choice(["", "", "", ".", ",", "\n", "\x0b", "!"]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "de", None, "und"]), " ".join(ws)))
    return [*rows, ("en", None), (None, ""), ("en", "?!"), ("fr", "one"), *rows[:40]]


def test_phrases(spark):
    rows = text_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({n: F.lit(1) for n in ("phrase", "f", "n", "size", "words", "a.b")}).repartition(3)
    for least, covered, top in ((100, 100, 2000), (8, 100, 2000), (8, 60, 5)):
        got = sorted(tuple(r) for r in phrases.mine_phrases(docs, least=least, covered=covered, top=top).collect())
        assert got == phrases_brute(rows, least=least, covered=covered, top=top) and got
    assert phrases.mine_phrases(docs.limit(0)).count() == 0


def test_phrases_of_texts_in_parts(monkeypatch):
    rows = text_rows(30)
    long = [("en", " ".join(t or "" for _, t in rows)), ("en", "ab " * 400), ("de", "x" * 3000 + " y y " * 90)]
    want = phrases_brute(long, least=5)
    for size in (40, 333):
        counts = Counter()
        for order in range(1, 6):
            for lang, text in long:
                for p in _parts(text, size, monkeypatch, order - 1):
                    for piece in re.split(r"[.,;:!?\x0A-\x0D]", p):
                        ws = re.findall(r"[^\x20\x09]+", piece)
                        counts.update((lang, *ws[i : i + order]) for i in range(len(ws) - order + 1))
        assert want and all(counts[lang, *p.split(" ")] == a for lang, _, p, a, *_ in want)


def _parts(text, size, monkeypatch, carry=0):
    monkeypatch.setattr(phrases, "CHUNK", size)
    return [x.decode() for x in phrases._parts(text.encode().lower(), carry)]


def test_a_crowded_bitmap_changes_nothing(spark, monkeypatch):
    rows = text_rows()
    monkeypatch.setattr(phrases, "MOST_BITS", phrases.BLOCK)
    monkeypatch.setattr(phrases, "BITS_EACH", 1)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.mine_phrases(docs, least=8).collect()) == phrases_brute(rows, least=8)


def test_scores_pass_64_bits(spark):
    big = 9 * 10**14
    row = spark.createDataFrame([(big, 10**16 + 1, big + 7, big + 3)], "a long, n long, l long, r long")
    assert row.select(phrases._score(*map(F.col, "anlr")).alias("s")).first()["s"] == 1000 * big * (10**16 + 1) // ((big + 7) * (big + 3))


@given_data
def test_phrases_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = queries.QUERIES["op12_phrase_collocations"](spark, DATA)
    want = con.execute(SQL["op12_phrase_collocations"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def best_first(rows: list[tuple[str, int]], begin: int = 0, ends=repair.ENDS):
    """The cheapest and least edits, by trying all in the order of (cost, audit)."""
    heap = [(0, "", 0, begin)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in ends:
            return cost, audit
        if cost > 4 * len(rows) + 12:
            return None
        for x in "ua":
            if (state, x) in repair.STEPS:
                heapq.heappush(heap, (cost + 3, audit + "I", i, repair.STEPS[state, x]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                if (state, initial) in repair.STEPS:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, repair.STEPS[state, initial]))
                for x in "ua":
                    if (state, x) in repair.STEPS:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, repair.STEPS[state, x]))
    return None


@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", " ", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=5), st.integers(0, 3), st.sampled_from([(0, 3), (0,), (1,), (2,), (3,)]))
@settings(max_examples=400, deadline=None)
def test_search(rows, begin, ends):
    assert repair.search([repair._moves(*r) for r in rows], begin, ends) == best_first(rows, begin, ends)


def repair_brute(rows: list[tuple]) -> list[tuple]:
    """Damage and repair in plain Python; the repair itself row by row with the best edits of each state."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        convs[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, live in convs.items():
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in live:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 0 if last[0] in ".!?" else 3)
            seen.add((role, text))
        known = [t for t, *_ in live if t is not None]
        first = [r[1][:1] for r in live]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))

        def inserted(best):
            for _ in range(3):
                for state, (c, e) in list(best.items()):
                    for x in "ua":
                        if to := repair.STEPS.get((state, x)):
                            best[to] = min(best.get(to, (1 << 60, "")), (c + 3, e + "I"))
            return best

        best = inserted({0: (0, "")})
        for initial, fault in zip(first, faults):
            new: dict = {}
            for state, (c, e) in best.items():
                ways = [("D", 4, state)]
                if fault not in (1, 2):
                    more = 3 if fault == 3 else 0
                    ways += [("K", more, repair.STEPS[state, initial])] if (state, initial) in repair.STEPS else []
                    ways += [("R", 3 + more, repair.STEPS[state, x]) for x in "ua" if (state, x) in repair.STEPS]
                for edit, w, to in ways:
                    new[to] = min(new.get(to, (1 << 60, "")), (c + w, e + edit))
            best = inserted(new)
        cost, audit = min(best[s] for s in (0, 3) if s in best)
        lines, state, i = [], 0, 0
        for edit in audit:
            if edit in "IR":
                initial = "a" if state == 2 else "u"
                lines.append(f"{ {'u': 'user', 'a': 'assistant'}[initial]}:{'' if edit == 'I' else live[i][2]}")
                state = repair.STEPS[state, initial]
            elif edit == "K":
                lines.append(f"{live[i][1]}:{live[i][2]}")
                state = repair.STEPS[state, first[i]]
            i += edit != "I"
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def chat_rows() -> list[tuple]:
    rng = random.Random(9)
    texts = ["Hello there.", "Fine!", "cut off", "", " \t", "What now?", "é.", None, "Yes.\n"]
    rows = [(rng.randrange(60), rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for _ in range(400)]
    rows += [(None, k, "user" if k % 2 else "assistant", rng.choice(texts)) for k in range(9)]
    rows += [(1000, k, rng.choice(["user", "assistant", "system"]), f"{k % 200} {rng.choice(['a.', 'b', 'c?'])}") for k in range(900)]  # longer than its pieces
    rows += [(1001, 5, "user", "All alike.")] * 30 + [(1002, -3, "user", "x."), (1002, 9, "assistant", "y.")]
    return rows + [(k, 0, "user", "Only one.") for k in range(2000, 2100)]


def test_repair(spark):
    rows = chat_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(1) for n in ("live", "part", "k", "n", "again", "h1", "gaps")}).repartition(5)
    want = repair_brute(rows)
    for size in (repair.PIECE, 7, 1):
        got = repair.repair(repair.damaged(table), size).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert any(r[4] for r in want) and any(r[2] == 0 and r[6] == 0 and not r[7] for r in want)
    assert repair.repair(repair.damaged(table.limit(0))).count() == 0
    named = spark.createDataFrame([(f"c{a}", *r) for a, *r in rows[:50]], "conv_id string, turn int, role string, text string")
    assert sorted((tuple(r) for r in repair.repair(repair.damaged(named)).collect()), key=repr) == repair_brute([(f"c{a}", *r) for a, *r in rows[:50]])


@given_data
def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_conversation_repair"](spark, DATA).collect()
    assert sorted(map(tuple, got), key=repr) == repair_brute(rows)


@given_data
def test_bpe_of_the_table(spark, library):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.QUERIES["op11_byte_level_bpe"](spark, DATA).collect())) == sorted(want)

