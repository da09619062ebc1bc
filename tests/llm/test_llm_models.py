"""URL filter, HTML extraction and language model against plain Python."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from boxmill.llm import html_text, lm, url_filter
from pyspark.sql import functions as F

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/x?q", "https://example.net", "http://x.net/", "http://www.example.com/de/1", "http://example.com/den", "http://notexample.com/de/1",
    "http://b.org/fr/1", "http://b.org/frx", "no scheme", None, "", "://", "http://casino-spam.example.org/es/1#a", "http://blog.garden.example.org/es/1", "ftp://h?x=/fr/",
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, url_filter.seed_urls(spark)).select("page_id", "url_filter.*").collect()}
    for k, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].lower(), m[2]
        fit = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fit, key=len, default=None)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        if rule:
            assert got[k]["verdict"] == {r: v for v, r in url_filter.RULES}[rule]
    assert (got[13]["verdict"], got[14]["verdict"]) == ("block", "allow")
    assert got[10]["verdict"] == got[11]["verdict"] == "allow"


def slots(host, path):
    if not host:
        return []
    framed, grams = f".{host}/", []
    for n in (3, 4, 5):
        grams += [f"h{n}" + framed[i : i + n] for i in range(len(framed) - n + 1)]
    grams += ["p3" + path[i : i + 3] for i in range(len(path) - 2)]
    return sorted({zlib.crc32(g.encode()) % url_filter.DIM for g in grams})


def test_training_equals_a_loop(spark):
    rows = [(f"http://{h}.example/en/1", y) for y, hs in ((1, url_filter.BLOCK[:6]), (0, url_filter.ALLOW[:6])) for h in hs]
    x, y = np.zeros((len(rows), url_filter.DIM + 1)), np.array([r[1] for r in rows])
    for k, (u, _) in enumerate(rows):
        s = slots(u.split("/")[2], "/en/1")
        x[k, s], x[k, -1] = 1 / math.sqrt(len(s)), 1
    w, v = np.zeros(url_filter.DIM + 1), np.zeros(url_filter.DIM + 1)
    for t in range(url_filter.EPOCHS):
        new = v - url_filter.RATE * (x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(rows) + url_filter.DECAY * v)
        w, v = new, new + t / (t + 3) * (new - w)
    got = url_filter.train(spark.createDataFrame([*rows, *rows, (None, 1), ("u", None)], "url string, label int"))
    assert np.allclose(got, w, atol=1e-9)
    none = url_filter.train(spark.createDataFrame([], "url string, label int"))
    assert len(none) == url_filter.DIM + 1 and not any(none)
    assert len(url_filter.train(spark.createDataFrame([("nothing", 1), ("http://", 0)], "url string, label int"))) == url_filter.DIM + 1


def test_held_out_domains(spark):
    """A quarter of the registered domains is judged by a model of the others, none of which is the same pair of words."""
    labelled = url_filter.seed_urls(spark)
    assert labelled.groupBy("domain").agg(F.count_distinct("label").alias("n")).where("n > 1").count() == 0
    test = F.pmod(F.crc32(F.col("domain").cast("binary")), F.lit(4)) == 0
    out = url_filter.judge_urls(labelled.where(test), labelled.where(~test), rules=())
    n = {(r["label"], r["verdict"]): r["n"] for r in out.groupBy("label", "url_filter.verdict").agg(F.count("*").alias("n")).collect()}
    right, blocked = n[(1, "block")] + n[(0, "allow")], n[(1, "block")] + n.get((0, "block"), 0)
    assert right / sum(n.values()) > 0.95 and n[(1, "block")] / blocked > 0.95


def test_odd_urls(spark):
    urls = ["http://a.example.net/" + "x" * 100_000, None, "", "nothing", "http://", "HTTP://A.Net?x", "http://A.b/ä", "http://A.b/ä"]
    d = spark.createDataFrame([(k, u, 1, 2) for k, u in enumerate(urls)], "page_id long, url string, `Url_Filter` int, `dotted.name` int")
    out = url_filter.judge_urls(d, url_filter.seed_urls(spark))
    assert out.columns == ["page_id", "url", "dotted.name", "url_filter"]
    got = {r["page_id"]: r["url_filter"] for r in out.collect()}
    assert [got[k]["verdict"] for k in (1, 2, 3, 4)] == ["allow"] * 4 and got[0]["rule"] == "net/" and got[5]["host"] == "a.net" and got[6] == got[7]
    assert url_filter.judge_urls(d.limit(0), url_filter.seed_urls(spark)).count() == 0


HTML = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One\n two&nbsp;three<br>four<p>Five &lt;x&gt; &eacute</p><div class="comments"><p>Reader</p></div><form>f</form></article><footer>&copy; z</footer>"""


def test_article(spark):
    assert html_text.article_text(HTML, None) == "A & B\n\nOne two three four\n\nFive <x> é"


@pytest.mark.parametrize("page", [
    '<body class="has-sidebar"><article><p>Own text</p></article></body>', '<html class="no-js search"><body id="comments"><article><p>Own text</p></article></body>',
    '<body><div class="content with-sidebar"><main><p>Own text</p></main></div></body>', '<body><article class="post comments-open related"><p>Own text</p></article></body>',
    '<body><div class="modal"><div id="overlay"><article><p>Own text</p><div class="share">Share</div></article></div></div><p>Up</p></body>',
])
def test_names_around_the_article_drop_nothing(page):
    assert html_text.article_text(page, None) == "Own text"


def test_names_still_drop_parts():
    related = '<div class="related"><article>Card</article></div>'
    assert html_text.article_text(f'<div><p>The text of the page</p>{related}</div>', None) == "The text of the page"
    assert html_text.article_text(f'<article>A{related}<ul class="x comment-list"><li>Reader</ul><p class="ad-box">Buy</p></article>', None) == "A"


@pytest.mark.parametrize("page, text", [
    # parts around the only article
    ('<body><form id="aspnetForm"><div><article><p>Hello</p></article></div></form>', "Hello"),
    ("<nav><ul><li>Menu<article><p>Hello</p></article>", "Hello"),
    ('<div title="the hidden valley"><article><p>Hello</article></div>', "Hello"),
    ('<article class="is hidden now"><p>Hello</p></article>', "Hello"),
    ('<main><article class="promo">Hello</article></main>', "Hello"),
    # hidden by an attribute of its own
    ('<article>A<div hidden>x</div><div aria-hidden="true">x</div><p style="color:red; display : none">x</p></article>', "A"),
    # quotes and signs in attributes
    ("<article><p title=don't>Hello</p></article>", "Hello"),
    ('<article><p title="a > b" data-x=\'c "d"\' e= f>Hello</p></article>', "Hello"),
    # comments, adverts and notices inside the article, teasers beside it
    ('<article>A<ol class="commentlist"><li>x</ol></article>', "A"), ('<article>A<div id="comments-wrap">x</div></article>', "A"), ('<article>A<div class="comment-thread">x</div></article>', "A"),
    ('<article>A<section class="user-comments">x</section></article>', "A"), ('<article>A<div class="adsbygoogle">x</div></article>', "A"), ('<article>A<div class="sponsored-content">x</div></article>', "A"),
    ('<article>A<div class="cookie-consent">x</div></article>', "A"), ('<article>A<div class="notice-box">x</div></article>', "A"), ('<article>A</article><article class="related">x</article>', "A"),
    ('<article><h1>T</h1><article class="comment">x</article></article>', "T"), ('<article>A<p class="no-comments">B</p><p class="adsorption">C</p></article>', "A\n\nB\n\nC"),
    # controls in a sentence are words, alone they are controls
    ("<article>Press <button>OK</button> now</article>", "Press OK now"), ("<article>A <label>kept?</label> B</article>", "A kept? B"), ("<article>A<p><button>Share</button></p></article>", "A"),
    ("<article>A<form>Name <label>x</label></form></article>", "A"),
])
def test_parts_by_structure_and_attributes(page, text):
    assert html_text.article_text(page, None) == text


def page(k, own):
    return f"<body><div>Welcome to the site of all good things, friend of ours</div><p>{own}</p><div>Home Shop Help</div></body>"


def test_repeated_substrings_go_without_an_article(spark):
    own = [" ".join(f"u{k}_{j}" for j in range(12)) for k in range(3)]
    rows = [(k, f"http://h.example.org/{k}", page(k, own[k])) for k in range(3)]
    rows += [(3, "http://other.example.org/", page(3, "alone here")), (4, None, None), (5, "http://h.example.org/5", ""), (6, "http://h.example.org/6", HTML), (7, "http://h.example.org/0", page(0, own[0]))]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(3)] == own
    assert got[3] == "Welcome to the site of all good things, friend of ours\n\nalone here\n\nHome Shop Help"
    assert got[4] == got[5] == ""
    assert got[6].startswith("A & B")
    assert got[7] == own[0]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(none).count() == 0


def test_fifty_pages_against_brute_force(spark):
    """Hosts with and without articles, with share lines and common class names; what to drop is found by comparing all pages."""
    import random

    rng = random.Random(8)
    words = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    menu = {h: words(14) for h in range(4)}
    rows, want = [], {}
    for k in range(50):
        h = k % 4
        own = [words(rng.randrange(3, 40)) for _ in range(4)]
        if h < 2:  # two hosts with articles; one repeats a line in them
            line = "Read on with our letter every day of the week" if h == 0 else ""
            body = "".join(f"<p>{x}</p>" for x in own[:2]) + f"<p>{line}</p>" + f'<p>{own[2]} <a class="share-link">inline</a> <span class="notice">text</span> end</p><div class="share">Share</div><p>{own[3]}</p>'
            page = f'<body class="page has-sidebar"><nav>{menu[h]}</nav><article class="post comments-open">{body}</article><div class="comments"><p>Reader</p></div></body>'
        else:
            page = f'<body><div>{menu[h]}</div><p>{own[0]}</p><p>{own[1]}</p><p>{own[2]}</p><p>{own[3]}</p><div>{menu[h]} more of it</div><footer>f</footer></body>'
        rows.append((k, f"http://h{h}.example.org/{k}", page, "x", 1))
        want[k] = own
    parsed = {k: html_text.blocks(r[2]) for k, r in enumerate(rows)}
    texts = {}
    for k, (found, article) in parsed.items():
        peers = [parsed[j] for j in parsed if j % 4 == k % 4 and j != k]
        if article:
            own = [t for t, inside, dropped in found if inside and not dropped]
            texts[k] = "\n\n".join(t for t in own if 1 + sum(t in [x for x, i, d in f if i and not d] for f, _ in peers) <= (len(peers) + 1) / 2)
            continue
        seen = set()
        for f, _ in peers:
            for t, _, _ in f:
                w = t.split(" ")
                seen |= {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))}
        kept = []
        for t, _, dropped in found:
            w = t.split(" ")
            gone = {j for i in range(max(1, len(w) - 7)) if tuple(w[i : i + 8]) in seen for j in range(i, min(i + 8, len(w)))}
            if not dropped and len(gone) < len(w):
                kept.append(" ".join(x for i, x in enumerate(w) if i not in gone))
        texts[k] = "\n\n".join(kept)
    d = spark.createDataFrame(rows, "page_id long, url string, html string, `Text` string, covered int")
    out = html_text.extract_text(d)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.columns == ["page_id", "url", "text"] and got == texts
    for k, own in want.items():
        if k % 4 < 2:
            assert got[k] == "\n\n".join([*own[:2], f"{own[2]} inline text end", own[3]])
        else:
            assert got[k].startswith("\n\n".join(own)) and menu[k % 4] not in got[k]


def test_long_page_is_whole(spark):
    body = "".join(f"<p>word{k} {'x' * 50}</p>" for k in range(5000))
    assert len(html_text.article_text(f"<article>{body}</article>", None).split("\n\n")) == 5000


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    move = rng.random((lm.STATES, lm.STATES))
    emit = rng.random((lm.SLOTS, lm.STATES))
    m = lm.Model(np.full(lm.STATES, 1 / lm.STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    texts = [rng.integers(0, lm.SLOTS, n).astype(np.uint16) for n in (1, 3, 9, 2, 9)]
    for got, text in zip(lm.forward_log10(texts, m), texts, strict=True):
        a = m.start * m.emit[text[0]]
        for x in text[1:]:
            a = (a @ m.move) * m.emit[x]
        assert got == pytest.approx(math.log10(a.sum()))


def test_expected_counts_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    m = lm.initial_model(lm.Vocabulary(np.array([]), np.array([]), np.array([]), np.ones(lm.SLOTS), 0, 0))
    text = rng.integers(0, lm.SLOTS, 3).astype(np.uint16)
    sums = {"emit": np.zeros((lm.SLOTS, lm.STATES)), "move": np.zeros((lm.STATES, lm.STATES)), "start": np.zeros(lm.STATES)}
    lm._expected(lm.cut_texts([text], m), m, sums)
    start, move, total = np.zeros(lm.STATES), np.zeros((lm.STATES, lm.STATES)), 0.0
    for path in product(range(lm.STATES), repeat=3):
        p = m.start[path[0]] * m.move[path[0], path[1]] * m.move[path[1], path[2]] * np.prod([m.emit[x, s] for x, s in zip(text, path, strict=True)])
        total += p
        start[path[0]] += p
        move[path[0], path[1]] += p
        move[path[1], path[2]] += p
    assert np.allclose(sums["start"], start / total) and np.allclose(sums["move"], move / total)
    assert sums["emit"].sum() == pytest.approx(3)


def random_model(seed):
    rng = np.random.default_rng(seed)
    move, emit, start = rng.random((lm.STATES, lm.STATES)) ** 3, rng.random((lm.SLOTS, lm.STATES)) ** 3, rng.random(lm.STATES)
    return lm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_pieces_count_as_whole_texts():
    m, rng = random_model(3), np.random.default_rng(4)
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (600, 1, 64, 65, 128, 190, 3)]

    def sums(size):
        out = {"emit": np.zeros((lm.SLOTS, lm.STATES)), "move": np.zeros((lm.STATES, lm.STATES)), "start": np.zeros(lm.STATES)}
        lm._expected(lm.cut_texts(texts, m, size), m, out)
        return out

    whole, pieces = sums(10_000), sums(64)
    assert all(np.allclose(whole[k], pieces[k]) for k in whole)
    assert whole["emit"].sum() == pytest.approx(sum(map(len, texts))) and whole["move"].sum() == pytest.approx(sum(len(t) - 1 for t in texts))


def test_score_equals_a_plain_model(spark):
    """Training and scoring in loops, for texts whose tokens all have slots of their own."""
    from collections import Counter

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{min(int(x), 30)}" for x in rng.exponential(8, int(rng.integers(1, 40))))) for i in range(40)] + [(99, "new w1 words w2")]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = {i: [*t.split(), "\n"] for i, t in rows}
    c = Counter(x for i, w in tokens.items() if i not in held for x in w)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    counts = lm.count_tokens(spark.createDataFrame([(t,) for i, t in rows if i not in held], "text string"))
    v = lm.bounded_vocabulary(counts)
    slot = {w: int(v.slots[np.searchsorted(v.hashes, np.uint64(lm.xxhash.xxh3_64_intdigest(w.encode())).astype(np.int64))]) for w in c}
    unknown = lambda w: lm.OWN + (lm.xxhash.xxh3_64_intdigest(w.encode()) & (lm.HASHED - 1))
    m = lm.initial_model(v)
    prior = v.slot_mass / v.slot_mass.sum() * lm.PRIOR

    def forward(seq):
        alphas, total = [], 0.0
        for t, x in enumerate(seq):
            a = (m.start if t == 0 else alphas[-1] @ m.move) * m.emit[x]
            total += math.log10(a.sum())
            alphas.append(a / a.sum())
        return alphas, total

    for _ in range(lm.ROUNDS):
        emit, move, start = np.zeros((lm.SLOTS, lm.STATES)), np.ones((lm.STATES, lm.STATES)), np.ones(lm.STATES)
        for i, w in tokens.items():
            if i in held:
                continue
            seq = [slot[x] for x in w]
            alphas, beta = forward(seq)[0], np.ones(lm.STATES)
            for t in range(len(seq) - 1, -1, -1):
                g = alphas[t] * beta
                emit[seq[t]] += g / g.sum()
                if t:
                    pair = m.move * np.outer(alphas[t - 1], m.emit[seq[t]] * beta)
                    move += pair / pair.sum()
                    beta = m.move @ (m.emit[seq[t]] * beta)
                    beta /= beta.sum()
                else:
                    start += g / g.sum()
        emit += prior[:, None]
        m = lm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    for i, w in tokens.items():
        seq = [slot.get(x, unknown(x)) for x in w]
        inside = sum(math.log10(1 / v.slot_mass[k]) for x, k in zip(w, seq, strict=True) if x not in slot)
        assert got[i] == pytest.approx(forward(seq)[1] + inside, rel=1e-9)


def test_scores(docs, doc_rows, no_docs):
    from collections import Counter

    got = sorted((tuple(r) for r in lm.score_texts(docs).collect()), key=repr)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), "\n"]
    c = Counter(x for d in doc_rows if not held(d[0]) for x in tokens(d[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(((d[0], held(d[0]), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d in doc_rows for w in [tokens(d[1])]), key=repr)
    key = lambda r: (repr(r[0]), r[2], round(r[5], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5])
        assert g[6] < 0
    assert lm.score_texts(no_docs).count() == 0
