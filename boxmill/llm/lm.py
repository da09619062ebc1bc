"""Operator 5, LM scoring with a hidden Markov language model.

Tokens emit through a bounded set of slots: the most frequent tokens have a slot
each, the others share hashed slots, inside of which smoothed counts over the
whole corpus tell them apart. Baum-Welch counts of slots, transitions and starts
are gathered in each partition and summed across them; the scaled forward
recursion over a whole text gives its exact likelihood under the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, cut, text_or_empty

STATES, ROUNDS, SEED = 8, 5, 11
#: Slots of single tokens, hashed slots (a power of 2), and tokens whose counts are broadcast: 16 bytes each.
OWN, HASHED, HOT = 12_288, 4_096, 262_144
SLOTS = OWN + HASHED
#: Texts of more tokens are trained in pieces of so many, which meet exactly at their boundaries.
PIECE = 1024
#: Weight of the corpus' slot distribution in each state's emissions.
PRIOR = 200.0
#: The end of a text as a token: no word holds white space.
END = b"\n"


@dataclass
class Vocabulary:
    """Bounded statistics of the training tokens: all sizes are fixed but the two totals."""

    hashes: np.ndarray  # sorted, of the hot tokens
    counts: np.ndarray
    slots: np.ndarray
    slot_mass: np.ndarray  # count + 1 of each token in a slot, and 1 for the unknown one in a hashed slot
    n: int
    v: int


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # slots x states


def _words(text: str | None) -> list[bytes]:
    tokens = (text or "").encode().lower().split()
    tokens.append(END)
    return tokens


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

    for batch in batches:
        for text in batch.column(0):
            seen.update(_words(text.as_py()))
            if len(seen) > 400_000:
                yield out()
                seen.clear()
    if seen:
        yield out()


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c): 64-bit hashes of the tokens of all texts, with their counts."""
    return cut(texts.mapInArrow(_token_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "vocabulary")


def bounded_vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # the counts from which on all tokens fit; only those rows go to the driver
    level = F.floor(F.log2(F.col("c").cast("double")) * 64)
    held, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r["count"]
        if held > HOT:
            break
        least = r["level"]
    top = counts.where(level >= least if least is not None else F.lit(False)).toPandas().sort_values(["c", "token"], ascending=[False, True])
    hashes, c = top["token"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    slots = np.where(np.arange(len(c)) < OWN, np.arange(len(c)), OWN + (hashes & (HASHED - 1)))
    mass = np.zeros(SLOTS)
    mass[: min(OWN, len(c))] = c[:OWN] + 1
    mass[OWN:] = 1
    for r in counts.groupBy(F.pmod("token", F.lit(HASHED)).alias("s")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[OWN + r["s"]] += r["m"]
    own = (hashes[:OWN] & (HASHED - 1)) + OWN
    np.subtract.at(mass, own, c[:OWN] + 1)  # the tokens with a slot of their own
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], c[order], slots[order].astype(np.int32), mass, int(total["n"] or 0), int(total["v"]))


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_log double, slot_log double, codes binary, rare array<long>, times array<long>"


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each text as slots, with the sums that need no other row; rare tokens are left for a join."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        rid = TaskContext.get().partitionId() << 36
        mass_log, known = np.log10(v.slot_mass.clip(1e-300)), WordHash()
        for batch in batches:
            rows = []
            for doc_id, text, held_out in zip(*batch.columns, strict=True):
                tokens = _words(text.as_py())
                h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens)).astype(np.int64)
                at = np.minimum(np.searchsorted(v.hashes, h), max(len(v.hashes) - 1, 0))
                hot = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), bool)
                slots = OWN + (h & (HASHED - 1))
                slots[hot] = v.slots[at[hot]]
                logs = np.log10(v.counts[at[hot]] + 1.0)
                hashed = slots >= OWN
                rare, times = np.unique(h[~hot], return_counts=True)
                inside = logs[hashed[hot]].sum() - mass_log[slots[hashed]].sum()
                rows.append((rid, doc_id.as_py(), held_out.as_py(), len(h), int(hot.sum()), logs.sum(), inside, slots.astype(np.uint16).tobytes(), rare, times))
                rid += 1
                if len(rows) == 500:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return cut(docs.select("doc_id", "text", "held_out").mapInArrow(encoded, ENCODED), "encoded")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in ENCODED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(longest x sequences) slots and, per step, how many sequences are that long; longest sequences first."""
    n = np.array([len(c) for c in codes])
    grid = np.zeros((n[0], len(codes)), np.uint16)
    for i, c in enumerate(codes):
        grid[: len(c), i] = c
    return grid, np.searchsorted(-n, -np.arange(n[0]), side="left")


def _groups(codes: list[np.ndarray], cells: int) -> Iterator[list[int]]:
    """Indices by falling length, in groups whose padded grids stay under so many cells."""
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    at = 0
    while at < len(order):
        size = max(1, cells // len(codes[order[at]]))
        yield order[at : at + size]
        at += size


def forward_log10(codes: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the likelihood of each whole slot sequence, by the scaled forward recursion."""
    out = np.zeros(len(codes))
    for group in _groups(codes, 2_000_000):
        grid, live = _padded([codes[i] for i in group])
        total = np.zeros(len(group))
        a = np.tile(model.start, (len(group), 1))
        for t, k in enumerate(live):
            a = (a if t == 0 else a[:k] @ model.move) * model.emit[grid[t, :k]]
            c = a.sum(axis=1)
            a /= c[:, None]
            total[:k] += np.log10(c)
        out[group] = total
    return out


@dataclass
class Pieces:
    """Parts of whole texts, with what the rest of their text says about their two ends."""

    codes: list[np.ndarray]
    first: np.ndarray  # whether the piece begins a text
    entry: np.ndarray  # state probabilities before its first token
    left: np.ndarray  # state probabilities at the last token before it, 0 for first pieces
    right: np.ndarray  # backward vector at its last token


def _transfers(codes: list[np.ndarray], model: Model) -> np.ndarray:
    """Per piece, up to a factor: the weight of all paths from a state at its first token to a state at its last."""
    out = np.zeros((len(codes), STATES, STATES))
    for group in _groups(codes, 2_000_000):
        grid, live = _padded([codes[i] for i in group])
        m = np.zeros((len(group), STATES, STATES))
        m[:, np.arange(STATES), np.arange(STATES)] = model.emit[grid[0]]
        for t, k in enumerate(live):
            if t:
                m[:k] = (m[:k] @ model.move) * model.emit[grid[t, :k], None, :]
            m[:k] /= m[:k].sum(axis=(1, 2), keepdims=True)
        out[group] = m
    return out


def cut_texts(texts: list[np.ndarray], model: Model, size: int = PIECE) -> Pieces:
    """The texts in pieces. Boundaries follow from products of the pieces' transfer matrices, so counts over pieces are those of whole texts."""
    codes = [c[i : i + size] for c in texts for i in range(0, len(c), size)]
    first = np.array([i == 0 for c in texts for i in range(0, len(c), size)], bool)
    entry, left, right = np.tile(model.start, (len(codes), 1)), np.zeros((len(codes), STATES)), np.ones((len(codes), STATES))
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(codes))
    several = [(i, j) for i, j in zip(starts, ends, strict=True) if j - i > 1]
    if several:
        index = np.concatenate([np.arange(i, j) for i, j in several])
        ways = dict(zip(index.tolist(), _transfers([codes[i] for i in index], model), strict=True))
        for i, j in several:
            for k in range(i + 1, j):
                a = entry[k - 1] @ ways[k - 1]
                left[k] = a / a.sum()
                entry[k] = left[k] @ model.move
            for k in range(j - 2, i - 1, -1):
                b = model.move @ (ways[k + 1] @ right[k + 1])
                right[k] = b / (left[k + 1] @ b)
    return Pieces(codes, first, entry, left, right)


def _expected(pieces: Pieces, model: Model, sums: dict[str, np.ndarray]) -> None:
    """Adds the expected counts of the pieces to sums."""
    codes = pieces.codes
    for group in _groups(codes, 300_000):
        grid, live = _padded([codes[i] for i in group])
        begins = pieces.first[group]
        steps = len(live)
        alpha = np.zeros((*grid.shape, STATES))
        scale = np.ones(grid.shape)
        for t, k in enumerate(live):
            a = pieces.entry[group] if t == 0 else alpha[t - 1, :k] @ model.move
            a = a[:k] * model.emit[grid[t, :k]]
            scale[t, :k] = a.sum(axis=1)
            alpha[t, :k] = a / scale[t, :k, None]
        beta = pieces.right[group]
        for t in range(steps - 1, -1, -1):
            if t < steps - 1:
                k = live[t + 1]
                ahead = model.emit[grid[t + 1, :k]] * beta[:k] / scale[t + 1, :k, None]
                sums["move"] += model.move * (alpha[t, :k].T @ ahead)
                beta[:k] = ahead @ model.move.T
            alpha[t] *= beta  # now the posterior; rows not live are 0
        later = ~begins
        if later.any():  # the steps from one piece to the next
            ahead = model.emit[grid[0, later]] * beta[later] / scale[0, later, None]
            sums["move"] += model.move * (pieces.left[group][later].T @ ahead)
        flat = grid.ravel()
        for s in range(STATES):
            sums["emit"][:, s] += np.bincount(flat, weights=alpha[:, :, s].ravel(), minlength=SLOTS)
        sums["start"] += alpha[0][begins].sum(axis=0)


def initial_model(vocabulary: Vocabulary) -> Model:
    draw = np.random.default_rng(SEED)
    emit = (vocabulary.slot_mass[:, None] + 1e-9) * np.exp(draw.normal(0.0, 1.0, (SLOTS, STATES)))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    even = np.full(STATES, 1.0 / STATES)
    return Model(even, move, emit / emit.sum(axis=0))


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts; the counts of a round are SLOTS + STATES + 1 rows of sums."""
    model = initial_model(vocabulary)
    prior = vocabulary.slot_mass / max(vocabulary.slot_mass.sum(), 1e-9) * PRIOR
    names = [f"s{s}" for s in range(STATES)]
    for _ in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = {"emit": np.zeros((SLOTS, STATES)), "move": np.zeros((STATES, STATES)), "start": np.zeros(STATES)}
            for batch in batches:
                texts = [np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()]
                if texts:
                    _expected(cut_texts(texts, shared.value), shared.value, sums)
            rows = np.concatenate([sums["emit"], sums["move"], sums["start"][None]])
            full = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(rows[full, s]) for s in range(STATES))], names=["row", *names])

        out = encoded.where(~F.col("held_out")).select("codes").mapInArrow(counted, "row int, " + ", ".join(f"{n} double" for n in names))
        rows = np.zeros((SLOTS + STATES + 1, STATES))
        for r in out.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).collect():
            rows[r["row"]] = r[1:]
        shared.unpersist()
        emit = rows[:SLOTS] + prior[:, None]
        move, start = rows[SLOTS : SLOTS + STATES] + 1.0, rows[-1] + 1.0
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def score(encoded: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per encoded text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(x, np.uint16) for x in batch.column("codes").to_pylist()]
            yield batch.drop_columns(["codes"]).append_column("likelihood", pa.array(forward_log10(codes, shared.value)))

    local = encoded.select("rid", "doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "slot_log", "codes")
    local = local.mapInArrow(forward, "rid long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_log double, slot_log double, likelihood double")
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "token").groupBy("rid").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_log"))
    out = local.join(rare, "rid", "left")
    known, rare_log = F.coalesce("n_rare", F.lit(0)), F.coalesce("rare_log", F.lit(0.0))
    base = F.col("hot_log") + rare_log - F.col("n_tokens") * float(np.log10(vocabulary.n + vocabulary.v + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + known).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("likelihood") + F.col("slot_log") + rare_log).alias("score"),
    )


def score_texts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", fold: int = 2, folds: int = 7) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id) mod `folds` is `fold` are held out of training. A
    token's probability in a hashed slot is (c + 1) over the slot's sum, which
    keeps one share for tokens not seen in training. Null or empty texts are the
    end token alone; null ids are in training; repeated rows count as often as
    they stand there, each with its score. Without training rows all counts are
    0. Empty tables give an empty result. Other columns don't matter.
    """
    id_ = F.col(doc_id).cast("long")
    held = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))
    d = docs.select(id_.alias("doc_id"), text_or_empty(F.col(text)).alias("text"), held.alias("held_out"))
    counts = count_tokens(d.where(~F.col("held_out")).select("text"))
    vocabulary = bounded_vocabulary(counts)
    encoded = encode(d, vocabulary)
    return score(encoded, counts, vocabulary, train(encoded, vocabulary))
