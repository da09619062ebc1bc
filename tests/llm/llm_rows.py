"""Rows that the tests of this folder share."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_docs() -> list[tuple]:
    """Texts with exact and near copies, shared lines, hits of a benchmark, junk, nulls and odd characters."""
    rng = random.Random(5)
    rows, base = [], [words(rng, rng.randrange(60, 160)) for _ in range(60)]
    for k, t in enumerate(base):
        rows.append((k, t, "en", f"src{k % 4}", len(t)))
    for k in range(60, 80):  # near copies: a few words changed
        w = base[k % 7].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((k, " ".join(w), "en", f"src{k % 4}", 0))
    rows += [(k, base[3], "en", "src0", 0) for k in range(80, 90)]
    rows += [(k, f"{words(rng, 80)}\nSubscribe to our letter now\n{words(rng, 20)}", "en", "src1", 0) for k in range(90, 125)]
    rows += [(125, "Subscribe to our letter now\n" * 3 + "Subscribe  TO our letter now", "en", "src1", 0)]
    rows += [(126, None, None, None, None), (127, "", "en", "src2", 0), (128, " \n\t ", "en", "src2", 3), (129, "one two", "en", "src2", 7), (130, "ONE\x0btwo", "fr", None, 7)]
    rows += [(131, "É é İ Σ 😀 a b ñ " * 30, "es", "src3", 0), (132, words(rng, 20_000, 3000), "en", "src0", 0)]
    rows += [(None, words(rng, 70), "en", "src0", 0), (None, None, None, "src1", None)]
    rows += [(133, "same row " * 40, "en", "src2", 0)] * 2
    return rows


def make_benchmark(docs: list[tuple]) -> list[tuple]:
    return [
        (1, " ".join(docs[5][1].split()[10:30])), (2, " ".join(docs[5][1].split()[15:27]).upper()), (10, " ".join(docs[8][1].split()[:9])), (11, "one two"), (12, None), (13, "..."),
        (14, "never seen words of a passage that no document has at all"), (None, " ".join(docs[9][1].split()[-12:])),
    ]
