"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader
(FTRL-proximal) updates and scored as sparse dot products.

Features of a text, all hashed to ``DIMENSIONS`` slots: its words (blank-separated, lower-cased), pairs
of neighbouring words, word shapes (runs of capitals, small letters, digits, each other byte),
pairs of shapes, and whether a word repeats the one or two before it.  A feature's value is its count over the
number of words (``mean``) or its count up to 1 (``presence``: a few decisive words in a long text).

The fit uses at most ``max_rows`` labelled rows, picked by a hash of their id (a documented bound: the
features of those rows are what one task holds).  Scoring streams over the documents without a shuffle;
the weights are a fixed 1 MB.

Defined cases: null texts score as empty ones (the intercept alone); null labels are ignored; labels that
repeat for an id are averaged and rounded half up; with no usable label every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textops import U64, bounded_batches, buffers, lean, mix, runs, segment_sums, slices, span_hashes, trim

BITS = 18
DIMENSIONS = 1 << BITS
GROUPS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:], _SHAPE[0x30:0x3A] = 0x41, 0x61, 0x61, 0x30


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(GROUPS x words slots, row offsets in words).  Slot 0 is kept empty."""
    starts, ends = runs(~_SPACE[raw], offsets)
    rows = np.searchsorted(starts, offsets)
    word = span_hashes(_LOW[raw], starts, ends)
    shape = _SHAPE[raw]
    first = np.zeros(len(raw), bool)
    first[starts] = True
    kept = first.copy()
    kept[1:] |= shape[1:] != shape[:-1]
    kept &= ~_SPACE[raw]
    at = np.concatenate([[0], np.cumsum(kept)])
    form = span_hashes(shape[kept], at[starts], at[ends])
    n = len(word)
    out = np.zeros((GROUPS, n), np.int64)
    down = U64(64 - BITS)
    slot = lambda h: (mix(h) >> down).astype(np.int64) | 1  # noqa: E731  odd slots: 0 stays empty
    if n:
        with np.errstate(over="ignore"):
            out[0] = slot(word)
            out[2] = slot(form + U64(2))
            inner = np.ones(n, bool)
            inner[rows[1:][rows[1:] > 0] - 1] = False
            out[1, :-1] = np.where(inner[:-1], slot(word[:-1] * U64(31) + word[1:]), 0)
            out[3, :-1] = np.where(inner[:-1], slot(form[:-1] * U64(37) + form[1:] + U64(4)), 0)
            same = np.zeros(n, np.int64)
            same[:-1] |= inner[:-1] & (word[:-1] == word[1:])
            same[:-2] |= inner[:-2] & inner[1:-1] & (word[:-2] == word[2:])
            out[4] = 2 + 2 * same
    return out, rows


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on (slots, values, label) rows."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.RandomState(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x, y = rows[k]
            i, x = np.append(i.astype(np.int64), DIMENSIONS), np.append(x, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(DIMENSIONS + 1))


class Scorer:
    """Probability of a label for each row of a text column."""

    def __init__(self, weights: np.ndarray, presence: bool):
        self.weights, self.presence = weights.astype(np.float32), presence

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return logits([self], raw, offsets)[:, 0]

    def of(self, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Dot products of rows given by their features."""
        if self.presence:
            out = _presence(self.weights, slots, rows)
        else:
            out = segment_sums(self.weights[slots].sum(axis=0, dtype=np.float64), rows) * SCALE / np.maximum(np.diff(rows), 1)
        return out + float(self.weights[DIMENSIONS])


def logits(scorers: list[Scorer], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, scorers) logits; the features of a text are formed once."""
    out = np.zeros((len(offsets) - 1, len(scorers)))
    for i, j in slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        slots, rows = features(raw[a:b], offsets[i : j + 1] - a)
        for k, s in enumerate(scorers):
            out[i:j, k] = s.of(slots, rows)
    return out


def probabilities(scorers: list[Scorer], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(scorers, raw, offsets), -35, 35)))


#: values of the mean features are counts times SCALE over words, so that learning rates suit them.
SCALE = 8.0


def _presence(weights: np.ndarray, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the weights of the distinct slots of each row; only slots with a weight are looked at."""
    held = np.flatnonzero(weights[slots].ravel())
    row = np.tile(np.repeat(np.arange(len(rows) - 1), np.diff(rows)), slots.shape[0])[held]
    pairs = np.unique(row * np.int64(DIMENSIONS) + slots.ravel()[held])
    return np.bincount(pairs // DIMENSIONS, weights[pairs % DIMENSIONS], len(rows) - 1)


def _sparse(presence: bool):
    """Row features for training: id, labels, slots and values as bytes.

    A task gives one row for each id, the least by size and checksum, so an id that many rows share stays one example.
    """

    def run(batches):
        best: dict[str, tuple] = {}
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            ids, labels = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(offsets):
                a, b = int(offsets[i]), int(offsets[j])
                slots, rows = features(raw[a:b], offsets[i : j + 1] - a)
                for r in range(j - i):
                    own, count = np.unique(slots[:, rows[r] : rows[r + 1]], return_counts=True)
                    count = count[own != 0].astype(np.float32)
                    own = own[own != 0].astype(np.int32)
                    values = np.minimum(count, 1) if presence else count * np.float32(SCALE / max(rows[r + 1] - rows[r], 1))
                    key = (len(own), zlib.crc32(own), zlib.crc32(values))
                    if ids[i + r] not in best or key < best[ids[i + r]][0]:
                        best[ids[i + r]] = (key, labels[i + r], own.tobytes(), values.tobytes())
        names = list(best)
        for k in range(0, len(names), 1000):
            part = [best[n] for n in names[k : k + 1000]]
            yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 1000], pa.string()), pa.array([x[1] for x in part], pa.list_(pa.float64())), pa.array([x[2] for x in part], pa.binary()), pa.array([x[3] for x in part], pa.binary())], names=["id", "y", "slots", "x"])

    return run


def _fit(n_labels: int, epochs: int, options: dict):
    def run(batches):
        # id -> (slots, values, labels, order): views of the batches, so the rows are held once
        best: dict[str, tuple] = {}
        for batch in batches:
            at = np.frombuffer(batch.column(2).buffers()[1], np.int32, batch.num_rows + 1, batch.column(2).offset * 4) // 4
            slots, values = (np.frombuffer(batch.column(c).buffers()[2] or b"", kind) for c, kind in ((2, np.int32), (3, np.float32)))
            for r, (name, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own, x = slots[at[r] : at[r + 1]], values[at[r] : at[r + 1]]
                key = (len(own), zlib.crc32(own), zlib.crc32(x), tuple(y))
                if name not in best or key < best[name][3]:
                    best[name] = (own, x, y, key)
        rows = sorted(best.values(), key=lambda r: r[3])  # the fit doesn't depend on the order of arrival
        del best
        for k in range(n_labels):
            own = [(i, x, float(y[k])) for i, x, y, _ in rows]
            w = ftrl(own, epochs, **options) if len({y for _, _, y in own}) > 1 else _constant([y for _, _, y in own])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["k", "w"])

    return run


def _constant(ys: list[float]) -> np.ndarray:
    w = np.zeros(DIMENSIONS + 1)
    if ys:
        p = (sum(ys) + 0.5) / (len(ys) + 1)
        w[DIMENSIONS] = np.log(p / (1 - p))
    return w


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", presence: bool = False, max_rows: int = 20_000, epochs: int = 3, **options) -> dict[str, Scorer]:
    """One binary classifier per target: a boolean-valued column over ``labels``.

    Labelled rows whose id hashes below max_rows / labelled ids are used: max_rows on average, with a standard deviation under its square root.
    """
    bounded_batches(docs.sparkSession)
    names = list(targets)
    known = labels.select(F.col(id_col).alias("__id"), *[targets[t].cast("double").alias(f"__{i}") for i, t in enumerate(names)]).dropna()
    known = known.groupBy("__id").agg(F.array(*[F.floor(F.avg(f"__{i}") + 0.5).cast("double") for i in range(len(names))]).alias("y"))
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the bound max_rows on the right side is what makes this broadcast safe
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "__id").select("text", "y", F.col("__id").cast("string").alias("id"))
    found = rows.mapInArrow(lean(_sparse(presence)), "id string, y array<double>, slots binary, x binary").repartition(1).mapInArrow(lean(_fit(len(names), epochs, options)), "k int, w binary").collect()
    weights = {r.k: np.frombuffer(r.w, np.float32) for r in found}
    return {t: Scorer(weights.get(i, _constant([])), presence) for i, t in enumerate(names)}


def score_column(scorers: list[Scorer]) -> Callable[[Column], Column]:
    """A column of float64 arrays: each scorer's probability; vectorised over Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    shared = [(s.weights, s.presence) for s in scorers]

    @arrow_udf("array<double>")
    def score(text: pa.Array) -> pa.Array:
        raw, offsets = buffers(text)
        p = probabilities([Scorer(w, presence) for w, presence in shared], raw, offsets)
        trim()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))

    return score


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_scorer(docs: DataFrame, labels: DataFrame, **options) -> Scorer:
    """P(quality = 1), learnt from labelled rows that aren't held out."""
    return fit(docs, labels.where(~held_out()), {"quality": F.col("quality") == 1}, **options)["quality"]


def score_quality(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    score = score_column([scorer])(F.col("text"))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", held_out("doc_id").alias("held_out"), score[0].alias("score"))
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score at least threshold, with all their columns."""
    return docs.where(score_column([scorer])(F.col(text_col).cast("string"))[0] >= threshold)
