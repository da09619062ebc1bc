"""The operators over documents against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from boxmill.llm import chat, decontam, dedup, licenses, mixing, quality, sharding
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)


# quality rules


def quality_brute(docs, limit):
    lines, of = defaultdict(set), {}
    for i, text, _, source, _ in docs:
        found = {re.sub(r"[\x20\x09-\x0D]+", " ", x.translate(LOWER)).strip(" ") for x in (text or "").split("\n")} - {""}
        of[(source, text or "")] = found
    n = Counter()
    for _, text, _, source, _ in docs:
        n.update((source, x) for x in of[(source, text or "")])
    often = {k for k, c in n.items() if c > limit}
    for (source, text), found in of.items():
        hit = sum(len(x) for x in found if (source, x) in often)
        if hit <= 0.25 * sum(map(len, found)):
            for x in found:
                lines[(source, x)].add(text)
    gone = {k for k in often if len(lines[k]) > limit}
    out = []
    for i, text, _, source, _ in docs:
        t = text or ""
        w = WORD.findall(t)
        c, cover = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        full = [x for x in t.split("\n") if WORD.search(x)]
        found = of[(source, t)]
        lost = [x for x in found if (source, x) in gone]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        depleted = bool(lost) and sum(map(len, lost)) > 0.5 * sum(map(len, found))
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(cover), failed, not failed and not depleted, len(lost)))
    return sorted(out, key=repr)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines"]


def test_quality_rules(docs, doc_rows):
    out = quality.quality_rules(docs)
    got = rows(out.select("doc_id", *[f"quality.{c}" for c in STATS]))
    assert got == quality_brute(doc_rows, 20)
    assert out.where("quality.n_removed_lines > 0").count() > 30


def test_cleaned_text_lacks_the_line(docs):
    out = quality.drop_rejected(docs)
    assert out.columns == docs.columns
    assert out.where(F.col("text").contains("Subscribe")).count() == 0
    assert {r["doc_id"] for r in out.collect()} >= {*range(125)}
    assert out.where("doc_id = 90").first()["n_chars"] == len(out.where("doc_id = 90").first()["text"])


def boilerplate_rows(n, menu, own):
    return [(k, f"{menu}\n{own(k)}", "site") for k in range(n)]


def judged(spark, data, **options):
    out = quality.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string"), min_words=5, **options)
    return [(r["kept"], r["n_removed_lines"]) for r in out.orderBy("doc_id").select("doc_id", "quality.*").collect()]


def test_pages_of_mostly_boilerplate_are_depleted(spark):
    menu = "\n".join(" ".join(f"m{i}_{j}" for j in range(12)) for i in range(9))
    assert judged(spark, boilerplate_rows(60, menu, lambda k: " ".join(f"own{k}_{j}" for j in range(10)))) == [(False, 9)] * 60
    # near copies: the same text with a word changed in one line, or in another line each, is left to near-dedup
    assert judged(spark, boilerplate_rows(60, menu, lambda k: f"the same last line but for {k} and nothing else in it")) == [(True, 0)] * 60
    lines = [x.split() for x in menu.split("\n")]
    near = [(k, "\n".join(" ".join([*x[:5], f"new{k}", *x[6:]] if i == k % 9 else x) for i, x in enumerate(lines)), "site") for k in range(60)]
    assert judged(spark, near) == [(True, 0)] * 60


def test_copies_of_documents_count_once(spark):
    data = [(100 * k + c, "\n".join([*(" ".join(f"t{k}_{i}_{j}" for j in range(6)) for i in range(3)), "Shared footer"]), "s") for k in range(30) for c in range(21)]
    assert judged(spark, data) == [(True, 1)] * len(data)


def test_the_limit_grows_with_the_host(spark):
    data = [(k, " ".join(f"t{k}_{j}" for j in range(20)) + ("\nrare remark" if k % 40 == 0 else "\nmenu" if k % 40 < 4 else ""), "s") for k in range(2000)]
    out = judged(spark, data)
    assert {k % 40 for k, x in enumerate(out) if x[1]} == {1, 2, 3}


# near-dedup


def dedup_brute(docs):
    sets, inverse = [], defaultdict(list)
    for k, (_, text, *_x) in enumerate(docs):
        w = WORD.findall((text or "").translate(LOWER))
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.append(s)
        for x in s:
            inverse[x].append(k)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverse[x] if j > k).items():
            if docs[k][0] is not None and docs[j][0] is not None and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(j)] = find(k)
    low = {}
    for k, d in enumerate(docs):
        if d[0] is not None:
            low[find(k)] = min(low.get(find(k), d[0]), d[0])
    return sorted(((d[0], len(sets[k]), low[find(k)] if d[0] is not None else None, d[0] is None or low[find(k)] == d[0]) for k, d in enumerate(docs)), key=repr)


def test_near_dedup(docs, doc_rows):
    assert rows(dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")) == dedup_brute(doc_rows)


def test_links_across_hubs_are_found(spark):
    """A chain of texts: each similar to the next only; a later hub or the prefix join must close every link."""
    import random

    rng = random.Random(1)
    chain = [[f"w{rng.randrange(10**6)}" for _ in range(120)]]
    for k in range(14):
        chain.append([*chain[-1][9:], *[f"c{k}_{j}" for j in range(9)]])
    out = dedup.near_duplicates(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(chain)], "doc_id long, text string"))
    assert {r["component_id"] for r in out.collect()} == {0}


def test_one_of_each_group_stays(docs, doc_rows):
    out = dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = sorted(r[0] for r in dedup_brute(doc_rows) if r[3] and r[0] is not None)
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == sorted(set(kept))


# decontamination


def leak_brute(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, text in items:
        w = word.findall((text or "").translate(LOWER))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, text, *_ in docs:
        w, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(docs, doc_rows, benchmark, spark):
    got = rows(decontam.decontaminate(docs, benchmark).select("doc_id", "leak.*"))
    items = [tuple(r) for r in benchmark.collect()]
    assert got == leak_brute(doc_rows, items)
    assert sum(r[5] for r in got) >= 5
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.drop_contaminated(docs, none).count() == len(doc_rows)


# mixing


def mix_brute(docs):
    size = defaultdict(int)
    for _, text, _, source, _ in docs:
        size[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    left, open_, target = sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if 3 * size[s] <= level * weight[s]}
        if not above:
            break
        for s in above:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
        open_ -= above
    return size, target | {s: level * weight[s] for s in open_}


def test_mixing(docs, doc_rows):
    size, target = mix_brute(doc_rows)
    got = mixing.mix(docs).select("doc_id", "source", "text", "mix.*").collect()
    taken = Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s, t in target.items():
        assert taken[s] <= t + 1e-6
        assert t - taken[s] <= max([n for n in (len(WORD.findall(d[1] or "")) for d in doc_rows if d[3] == s) if n < 20_000], default=0)
    again = mixing.mix(docs.repartition(5)).select("doc_id", "text", "mix.copies")
    assert rows(again) == rows(mixing.mix(docs).select("doc_id", "text", "mix.copies"))


def greedy_copies(rows, target, cap=3):
    """rows: (key, size, draw) of one source. A walk by draw that takes what fits, turn after turn."""
    total = sum(n for _, n, _ in rows)
    whole = min(int(target // total), cap) if total else 0
    need, copies = target - whole * total, Counter({k: whole for k, _, _ in rows})
    by_draw = defaultdict(list)
    for k, n, d in rows:
        by_draw[d].append((k, n))
    for _ in range(cap - whole):
        for d in sorted(by_draw):
            n = sum(n for _, n in by_draw[d])
            if need >= 1 and 0 < n <= need:
                need -= n
                copies.update(k for k, _ in by_draw[d])
    return copies


def test_mixing_takes_what_a_walk_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 10)
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), F.when(F.col("id") == 4, 60_000).otherwise(F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"))
    got = mixing.mix(d).select("doc_id", "source", "mix.size", "mix.target", "mix.copies", mixing._draw(7, F.col("doc_id"), F.col("text")).alias("draw")).collect()
    for s in "abc":
        rows_of = [r for r in got if r["source"] == s]
        assert {r["doc_id"]: r["copies"] for r in rows_of} == dict(greedy_copies([(r["doc_id"], r["size"], r["draw"]) for r in rows_of], rows_of[0]["target"]))
        assert abs(sum(r["size"] * r["copies"] for r in rows_of) - rows_of[0]["target"]) <= max(60, 0.001 * rows_of[0]["target"])


def test_mixed_rows_repeat(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == mixing.mix(docs).agg(F.sum("mix.copies")).first()[0]


# sharding


def test_sharding(docs, doc_rows):
    out = sharding.shard(docs).select("doc_id", "text", "shard.*").collect()
    assert len(out) == len(doc_rows)
    slots = defaultdict(list)
    for r in out:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(40))


def test_shards_have_equal_bytes(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 20)).otherwise(F.repeat(F.md5(F.col("id").cast("string").cast("binary")), (F.col("id") % 7).cast("int"))).alias("text"))
    out = sharding.shard(d).select("text", "shard.*")
    sizes = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40
    assert max(sizes) <= 1.03 * sum(sizes) / 40
    assert min(sizes) >= 0.97 * sum(sizes) / 40
    pieces = out.where(F.col("text") != F.lit("copy " * 20)).where("text <> ''").groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert pieces.where("n > 1").count() == 0


# licences


def test_licences(spark):
    texts = ["x. Released under the MIT License.\nAll rights reserved.", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License! You may obtain a copy of the License at\nhttp", "nothing", None, "", "ALL RIGHTS RESERVED"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"], r["licence"]) for r in licenses.scan_licenses(d).select("doc_id", "licence.*").collect()}
    assert got[0] == (["mit", "all-rights"], ["MIT", "proprietary"], "MIT")
    assert got[1] == (["apache-2", "apache-2-use", "licence-at"], ["Apache-2.0"], "Apache-2.0")
    assert got[2] == got[3] == got[4] == ([], [], None)
    assert got[5][2] == "proprietary"


def test_licences_whatever_stands_between_the_words(spark):
    texts = ["Dedicated to the public-domain.", "All rights  reserved", "x.\nAll rights\treserved.", "All rights\u00a0reserved", "All rights, reserved"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select("licence.licence").collect()
    assert [r["licence"] for r in got] == ["CC0-1.0", *["proprietary"] * 4]


# empty tables and clashing names


def test_empty_tables(no_docs, benchmark):
    assert quality.quality_rules(no_docs).count() == 0
    assert dedup.near_duplicates(no_docs).count() == 0
    assert dedup.drop_near_duplicates(no_docs).count() == 0
    assert decontam.decontaminate(no_docs, benchmark).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert sharding.shard(no_docs).count() == 0
    assert licenses.scan_licenses(no_docs).count() == 0


def test_clashing_names(docs, clashing, benchmark):
    plain = {
        "quality": quality.quality_rules, "leak": lambda d: decontam.decontaminate(d, benchmark), "mix": mixing.mix, "shard": sharding.shard, "licence": licenses.scan_licenses,
    }
    for to, op in plain.items():
        assert rows(op(clashing).select("doc_id", F.to_json(to))) == rows(op(docs).select("doc_id", F.to_json(to))), to
    assert rows(dedup.near_duplicates(clashing)) == rows(dedup.near_duplicates(docs))
    for stage in (quality.drop_rejected, dedup.drop_near_duplicates, mixing.mixed):
        assert stage(clashing).columns == clashing.columns


# chat


def test_tool_calls(spark):
    c = [
        (1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls": [{"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "name": "add", "after": "a", "arguments": {"x": "1", "z": 0}}]}'),
        (1, 2, "tool", '{"id": "a", "content": "3"}'), (1, 3, "tool", '{"id": "a", "content": "2"}'), (1, 4, "assistant", '{"tool_calls": [{"id": "c", "name": "no", "after": "d", "arguments": {}}, {"id": "d", "name": "add", "after": "c", "arguments": 5}]}'),
        (2, None, "user", None), (None, 1, "assistant", "x"), (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "é\"\n"), (3, 3, "user", "r"), (3, 3, "user", "r"),
    ]
    schemas = chat.SCHEMAS | {"add": {"x": ("integer", True), "y": ("integer", False)}}
    out = chat.link_tool_calls(chat.messages(spark.createDataFrame(c, "conv_id long, turn long, role string, text string")), schemas)
    by = defaultdict(list)
    for r in out.collect():
        by[(r["kind"], r["call_id"])].append(r)
    a, b, cc, dd = (by[("call", x)][0] for x in "abcd")
    assert (a["depth"], a["linked"], a["n_results"], a["valid"]) == (0, True, 2, True)
    assert a["json"] == '{"after":[],"arguments":{"x":1,"y":2},"call_id":"a","depth":0,"name":"add","result":"2","valid":true}'
    assert (b["depth"], b["after"], b["linked"], b["errors"]) == (1, "a", False, "x: not integer; z: unknown")
    assert cc["depth"] is None and "cycle" in cc["errors"] and "unknown tool" in cc["errors"]
    assert "arguments: not an object" in dd["errors"]
    assert [r["depth"] for r in by[("call", "3:3")]] == [1, 1]
    assert by[("call", None)][0]["errors"] == "text: missing; turn: missing" and not by[("call", None)][0]["linked"]
    assert by[("result", "3:1")][0]["json"] == '{"call_id":"3:1","content":"é\\"\\n","role":"assistant"}'
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.link_tool_calls(chat.messages(empty)).count() == 0


def test_calls_link_inside_their_conversation(spark):
    def call(after):
        return ' \n{"content": null, "tool_calls": [{"id": "call_1", "name": "add", "after": %s, "arguments": {"x": "1"}}, {"id": "call_2", "name": "add", "arguments": {"x": 1}}]}' % after

    c = [(1, 0, "assistant", call('"call_2"')), (1, 1, "tool", '{"id": "call_1", "content": "b"}'), (2, 0, "assistant", call("null")), (2, 1, "tool", ' {"id": "call_1", "content": "a"}'), (3, 0, "assistant", call("null")), (3, 1, "assistant", "tool_calls")]
    schemas = spark.createDataFrame([("add", "x", "integer", True)], "tool string, field string, type string, required boolean")
    out = chat.link_tool_calls(chat.messages(spark.createDataFrame(c, "conv_id long, turn long, role string, text string")), schemas)
    got = {(r["conv_id"], r["call_id"]): (r["depth"], r["linked"], r["n_results"], r["errors"], '"result":"b"' in r["json"], '"result":"a"' in r["json"]) for r in out.where("kind = 'call'").collect()}
    wrong = "x: not integer"
    assert got == {
        (1, "call_1"): (1, True, 1, wrong, True, False), (2, "call_1"): (0, True, 1, wrong, False, True), (3, "call_1"): (0, False, 0, wrong, False, False),
        **{(k, "call_2"): (0, False, 0, "", False, False) for k in (1, 2, 3)},
    }


def test_long_chain_of_calls(spark):
    n = 300
    calls = spark.range(n).select(F.lit(1).alias("conv_id"), (F.col("id") * 2).alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    out = chat.link_tool_calls(chat.messages(calls))
    assert sorted(r["depth"] for r in out.collect()) == list(range(n))


def test_no_turn_is_lost_and_calls_have_several_predecessors(spark):
    def c(*calls):
        return '{"content": "beside", "tool_calls": [%s]}' % ", ".join('{"id": "%s", "name": "t", "after": %s, "arguments": %s}' % x for x in calls)

    args = '{"place": {"city": "x"}, "tags": ["a"], "unit": "m"}'
    turns = [
        (1, 0, "assistant", c(("a", "null", args), ("b", '"a"', args), ("c", '"a"', args), ("d", '["b", "c", "zz"]', args), ("e", '["d", "a"]', args), ("f", '["e"]', args))),
        (2, 0, "assistant", '{"tool_calls": []}'), (2, 1, "assistant", '{"tool_calls": [null]}'), (2, 2, "assistant", '{"tool_calls": 5}'), (2, 3, "tool", "[]"),
        (3, 0, "assistant", c(("a", '["b", "c"]', '{"place": {"city": 1}, "tags": [1], "unit": "q"}'), ("b", '"a"', '{"tags": [], "more": 1}'), ("c", "null", args), ("d", '"b"', args))),
        (4, 0, "assistant", '{"tool_calls": [null, {"id": "x", "name": "t", "arguments": {}}]}'), (5, 0, "user", "w" * 300_000),
    ]
    schemas = {"t": {"place.city": ("string", True), "tags": ("array<string>", False), "unit": ("string", False, ("m", "km"))}}
    rows_in = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.link_tool_calls(chat.messages(rows_in), schemas).collect()
    calls = {(r["conv_id"], r["call_id"]): r for r in out if r["kind"] == "call"}
    assert {k: calls[(1, k)]["depth"] for k in "abcdef"} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4}
    assert calls[(1, "d")]["after"] == "b,c" and '"after":["b","c"]' in calls[(1, "d")]["json"] and all(calls[(1, k)]["valid"] for k in "abcdef")
    assert [calls[(3, k)]["depth"] for k in "abcd"] == [None, None, 0, None]
    assert calls[(3, "a")]["errors"] == "place.city: not string; tags: not array<string>; unit: not allowed; cycle"
    assert calls[(3, "b")]["errors"] == "place.city: missing; more: unknown; cycle"
    assert {(r["conv_id"], r["turn"]) for r in out} == {t[:2] for t in turns}
    assert sorted(r["conv_id"] for r in out if r["kind"] == "message" and '"content":"beside"' in r["json"]) == [1, 3]


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "Apache-2.0": """# Copyright 2020 Somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
""",
    "GPL-3.0": """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
""",
}


def test_standard_notices(spark):
    got = licenses.scan_licenses(spark.createDataFrame(list(NOTICES.items()), "want string, text string")).select("want", "licence.*").collect()
    assert {r["want"]: r["licence"] for r in got} == {k: k for k in NOTICES}
    ids = {r["want"]: r["sentence_ids"] for r in got}
    assert ids["MIT"] == ["mit", "mit-grant", "mit-notice", "as-is", "mit-liability"]
    assert ids["Apache-2.0"] == ["apache-2", "licence-at", "apache-2-basis", "apache-2-see"] and ids["GPL-3.0"] == ["gpl-3", "gnu-hope", "gnu-see"]
    own = {"do what you like": "free"}
    assert licenses.scan_licenses(spark.createDataFrame([(1, "Do what\nyou like! " * 3)], "doc_id long, text string"), sentences=own, rules=(("Own", ("free",)),)).first()["licence"]["licences"] == ["Own"]


PROBES = {
    "// SPDX-License-Identifier: MIT\nint x;": "MIT", "MIT License": "MIT", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "License: Apache-2.0": "Apache-2.0",
    "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "This page is available under a Creative Commons Attribution 4.0 International License (CC BY 4.0).": "CC-BY-4.0",
    "This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.": "MIT", "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)": "BSL-1.0",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n": "ISC",
    "This is free and unencumbered software released into the public domain.\n\nAnyone": "Unlicense", "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING": "EPL-2.0",
    "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n": "EPL-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": "GPL-3.0", "All text is licensed under CC-BY-NC 3.0.": "CC-BY-NC-3.0", "https://creativecommons.org/licenses/by-nd/4.0/": "CC-BY-ND-4.0",
    "mit": None, "License: see below": None, "The weather is available under the bridge.": None, "We are licensed under the table.": None,
}


def test_licences_by_name(spark):
    d = spark.createDataFrame(list(PROBES), "string").toDF("text")
    assert {r["text"]: r["licence"] for r in licenses.scan_licenses(d).select("text", "licence.licence").collect()} == PROBES


def test_licence_table_as_rows(spark):
    d = spark.createDataFrame([("Foo bar. The end! Baz.",), (None,)], "text string")
    rows = spark.createDataFrame([("foo  BAR", "x"), ("foo bar", "w"), ("Baz", "y"), (None, "z"), ("q", None), ("...", "e")], "sentence string, id string")
    out = licenses.scan_licenses(d, sentences=rows, rules=(("L", ("w", "y")), ("M", ("y", "w")))).collect()
    assert sorted((r["licence"]["sentence_ids"], r["licence"]["licences"]) for r in out) == [([], []), (["w", "y"], ["L"])]
    assert licenses.scan_licenses(d, sentences=rows.limit(0)).where("size(licence.sentence_ids) > 0").count() == 0


def test_near_copies_under_the_threshold_rarely_meet(spark, monkeypatch):
    """Copies of one text with three words changed: few links, found exactly, and few pairs."""
    import random

    rng, n = random.Random(5), 240
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(120), 3):
            w[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    made, plain = [], dedup._exact_pairs
    monkeypatch.setattr(dedup, "_exact_pairs", lambda *a: made.append(plain(*a).count()) or plain(*a))
    out = dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    want = {r[0]: r[2] for r in dedup_brute([(i, t, None, None, 0) for i, t in enumerate(texts)])}
    assert got == want and 1 < len(set(want.values())) < n
    assert sum(made) < 0.2 * n * (n - 1) / 2


def test_keys_of_the_same_members_are_one_group(spark):
    """Forty parts that the same near copies share were forty smaller groups with whole sets each."""
    of = [(k, True, m, m) for k in range(40) for m in range(20)] + [(40, True, m, m) for m in range(19)] + [(41, False, m, m) for m in range(20)]
    of += [(42, True, 1, 1), (43, True, 1, 1), (43, True, 2, 1)]  # one root holds these
    of += [(44, True, 1, 1), (44, True, 1, 1), (44, True, 2, 2), (45, True, 3, 3), (45, True, 3, 3), (45, True, 2, 2)]  # ids of two texts
    kept = dedup._kept_keys(spark.createDataFrame(of, "key long, own boolean, rep long, root long"))
    assert rows(kept.groupBy("key", "m").count()) == [(0, 20, 20), (40, 19, 19), (44, 3, 3), (45, 3, 3)]


def test_a_round_of_stars_is_two_exchanges(spark):
    """Six of them, each of as many tasks as there are partitions, and a last round that changed nothing were most of near-dedup's tasks."""
    import re

    from boxmill.llm import components as C

    edges = spark.range(1, 200).selectExpr("id AS a", "id DIV 2 AS b")
    one = C._small_star(C._large_star(edges))
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(set(re.findall(r"Exchange hashpartitioning.*plan_id=(\d+)", plan))) == 2
    assert {tuple(r) for r in C.components(edges, "a", "b").collect()} == {(k, 0) for k in range(200)}


def test_sides_are_counted_without_texts(spark, monkeypatch):
    """Pairs were counted by their second side after the texts of the first had been joined, so these were shuffled twice."""
    from boxmill.llm import dedup

    counted = []
    monkeypatch.setattr(dedup, "cut", lambda df, tag: counted.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    docs = spark.createDataFrame([(k, f"text {k}") for k in (1, 2, 3)], "doc_id long, text string")
    beside = sorted(dedup._links(pairs, docs).collect())
    assert beside == [] and len(counted) == 3 and not any("text" in plan for plan in counted)


def test_what_a_group_has_in_common_is_not_looked_up(spark, monkeypatch):
    """All shingles of all members were exchanged a second time; only those outside the centre have to be."""
    from boxmill.llm import dedup

    seen, cut = {}, dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df, tag: seen.setdefault(tag, cut(df, tag)))
    sets = spark.createDataFrame([(k, [*range(100), 1000 + k // 2], k) for k in range(8)], "rep long, shingles array<long>, sid long")
    members = sets.selectExpr("0L AS grp", "rep", "rep AS root")
    dedup._exact_pairs(members, sets).collect()
    assert seen["beside"].selectExpr("sum(size(beside))").first()[0] == 8
    parts = {r["rep"]: r["parts"] for r in seen["differences"].collect()}
    assert parts == {k: [1000 + k // 2] for k in range(8)}
