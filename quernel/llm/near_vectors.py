"""Embedding near-dedup: spherical-cap filters from structured random product codes.

A unit vector is cut into ``blocks`` parts; each part has a codebook of random directions, and one codeword of
each part, glued together, is a filter direction.  Each vector is list-decoded to all filters whose cap it is
in: codewords are chosen part by part, and a choice is given up as soon as the best rest can't reach the
threshold.  Vectors that share a filter are compared, first by sketches of a byte a component with a bound of their error that loses no link,
then, where those allow it, by cosine in double precision; only the sketch of a vector goes to each of its filters.

Recall: two vectors at cosine c share a given filter of one of them with the chance that the other passes too; lists are so long that
this leaves about 1 in 1000 pairs at cosine 0.9 itself and fewer above (measured: 0.999 of 1000 pairs with codebooks for 1e9 rows, all of 3000 for 1e6 and for 51,000).  A vector
in fewer caps takes its best filters up to that number (``least``).  The codebooks grow with the number of rows,
so that the members expected of a filter stay at about ``OCCUPANCY``.

Equal vectors are one class with a number of copies.  Defined cases: vectors that are null, empty, zero or hold
null or non-finite components link with nothing and are kept; vectors of different lengths never link; rows that
repeat an id are vectors of their own, linked if equal; a null id sorts before others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .links import SALTS, bucket_links, components, distinct_reps, matrix, with_least
from .shared import materialize
from .textops import U64, lean, mix

THRESHOLD = 0.9
#: least filters of a vector where there are as many, members expected of a filter
LIST, OCCUPANCY = 64, 64
#: lists are so many times longer than they were if a filter's shares were independent
MARGIN = 7


class Filters:
    """The filter directions for vectors of one length."""

    def __init__(self, dim: int, n: int):
        want = LIST
        while True:  # as many filters as give OCCUPANCY members each, and a list that keeps the recall at that many
            filters = max(1024, want * n // OCCUPANCY)
            self.blocks = min(dim, max(2, math.ceil(math.log(filters) / math.log(2048))))
            t = _normal_tail(want / filters)
            both = math.erfc((t - THRESHOLD * (t + 1 / t)) / math.sqrt(1 - THRESHOLD**2) / math.sqrt(2)) / 2
            longer = max(LIST, math.ceil(MARGIN * 2 ** (self.blocks - 2) * math.log(1000) / -math.log(1 - both)))
            if longer <= want:
                break
            want = longer
        self.words = max(8, round(filters ** (1 / self.blocks)))
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        rng = np.random.RandomState(dim)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            c = rng.standard_normal((b - a, self.words))
            self.codes.append(c / np.linalg.norm(c, axis=0) * math.sqrt((b - a) / dim))
        self.least = min(want, self.words**self.blocks)
        # a cap holds the share want / filters of all directions
        self.bar = _normal_tail(min(0.5, want / self.words**self.blocks)) / math.sqrt(dim)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The filters of each unit vector."""
        scores = [x[:, a:b] @ c for (a, b), c in zip(zip(self.cuts[:-1], self.cuts[1:]), self.codes)]
        row, code, _ = self._above(scores, np.full(len(x), self.bar))
        few = np.flatnonzero(np.bincount(row, minlength=len(x)) < self.least)
        bar = np.full(len(x), self.bar)
        while len(few):
            bar[few] -= 0.05 * abs(self.bar) + 1e-3
            r, c, score = self._above([s[few] for s in scores], bar[few])
            count = np.bincount(r, minlength=len(few))
            enough = count >= self.least
            # of those above the lower bar, the best
            order = np.lexsort((c, -score, r))
            rank = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            r, c = r[order[rank < self.least]], c[order[rank < self.least]]
            own = ~np.isin(row, few[enough])
            on = enough[r]
            row, code = np.concatenate([row[own], few[r[on]]]), np.concatenate([code[own], c[on]])
            few = few[~enough]
        order = np.lexsort((code, row))
        return np.split(code[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])

    def _above(self, scores: list[np.ndarray], bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = [s.max(axis=1) for s in scores]
        rest = np.cumsum([np.zeros(len(bar)), *best[:0:-1]], axis=0)[::-1]
        row, code, part = np.arange(len(bar)), np.zeros(len(bar), np.int64), np.zeros(len(bar))
        for s, left in zip(scores, rest):
            rows, codes, parts = [], [], []
            step = max(1, (1 << 21) // self.words)
            for k in range(0, len(row), step):
                r = row[k : k + step]
                total = part[k : k + step, None] + s[r]
                at, word = np.nonzero(total + left[r][:, None] >= bar[r][:, None])
                rows.append(r[at])
                codes.append(code[k : k + step][at] * self.words + word)
                parts.append(total[at, word])
            if not rows:  # no choice is left
                return row, code, part
            row, code, part = np.concatenate(rows), np.concatenate(codes), np.concatenate(parts)
        return row, code, part


def _normal_tail(p: float) -> float:
    """The t with P(N(0, 1) > t) = p."""
    lo, hi = -8.0, 38.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(mid / math.sqrt(2)) / 2 > p else (lo, mid)
    return lo


def _decode(n: int):
    made: dict[int, Filters] = {}

    def run(batches):
        for batch in batches:
            rep, copies, vectors = batch.columns
            at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy().astype(np.float64)
            size = np.diff(at)
            for dim in np.unique(size):
                which = np.flatnonzero(size == dim)
                f = made.setdefault(int(dim), Filters(int(dim), n))
                for k in range(0, len(which), 2048):
                    w = which[k : k + 2048]
                    x = values[at[w][:, None] + np.arange(dim)]
                    unit = x / np.abs(x).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    with np.errstate(over="ignore"):
                        keys = [np.unique(mix(c.astype(U64) + U64(dim) * U64(0x9E3779B97F4A7C15)).view(np.int64)) for c in f.decode(unit)]
                    yield pa.RecordBatch.from_arrays(
                        [rep.take(pa.array(w)), copies.take(pa.array(w)), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys))), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in sketches(unit)], pa.binary())],
                        names=["rep", "copies", "keys", "payload", "sketch"],
                    )

    return run


def sketches(unit: np.ndarray) -> np.ndarray:
    """Per unit vector: its components rounded to steps of a 127th of the largest, then as float32 the step and the length of what rounding took away."""
    step = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    q = np.rint(unit / step[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    off = np.linalg.norm(unit - q * step[:, None].astype(np.float64), axis=1).astype(np.float32)
    return np.concatenate([q.view(np.uint8), step[:, None].view(np.uint8), off[:, None].view(np.uint8)], axis=1)


def may_link(threshold: float):
    """Of sketches, whether the cosine of the vectors may be threshold or more: |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|."""

    def verify(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (a, da), (b, db) = ((v[:, :-8].view(np.int8).astype(np.float32) * v[:, -8:-4].copy().view(np.float32), v[:, -4:].copy().view(np.float32)[:, 0]) for v in (x, y))
        return a @ b.T >= np.float32(threshold - 1e-4) - (da[:, None] + db[None] * (1 + da[:, None]))

    return verify


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and y in double precision; rows are scaled first so that nothing overflows."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # adding 0.0 makes -0.0 equal to 0.0; what can't be compared has no v
    v = F.transform("v", lambda c: c + F.lit(0.0))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("v", lambda c: c != 0)
    rows = rows.select("id", F.when(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)), v).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = classes.select(F.xxhash64("v", F.lit(3)).alias("h1"), F.xxhash64("v").alias("h2"), "first", "copies", "v")
    classes = distinct_reps(materialize(spark, classes, "vectors"))
    n = classes.count()
    signed = classes.select("rep", "copies", "v").mapInArrow(lean(_decode(n)), "rep long, copies long, keys array<long>, payload binary, sketch binary")
    signed = materialize(spark, signed, "filters")
    items, full = signed.select("rep", "keys", "sketch"), signed.select("rep", "copies", "keys", "payload")
    linked, edges = bucket_links(spark, items, may_link(threshold), "uint8", lambda reps: full.join(reps, "rep"), matrix(lambda x, y: cosines(x, y) >= threshold, "float64"))
    groups = classes.select("rep", "h1", "h2", "first", "copies").join(linked, "rep", "left").join(components(spark, edges).withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or linked is not null")
    groups = materialize(spark, groups.withColumn("root", F.coalesce("root", "rep")), "groups")
    groups = with_least(groups)
    groups = groups.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    member = rows.select("id", *[F.when(F.col("v").isNotNull(), F.xxhash64("v", *s)).alias(h) for h, s in (("h1", [F.lit(3)]), ("h2", []))], F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    df = member.join(groups, ["h1", "h2", "salt"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return df.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
