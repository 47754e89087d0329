"""Mixing sources to target weights by soft membership.

Domains come from the labelled table: ``low`` (quality 0), ``toxic`` (quality 1, toxic 1) and ``good``.  Classifiers
fitted to it give every document, labelled or not, a posterior over the domains.  Projected-gradient least squares
then fits a nonnegative rate per document so that the expected tokens of each domain, the sum of rate x tokens x
posterior, match the targets: all rates start at 1, and each step moves every rate along its own posterior,
``rate <- project(rate + posterior . v)``.  The step v is the negative gradient over domains, scaled by the domains' second
moments, so a few steps do.  A step needs sums over all documents of as many numbers as domains (squared), never the
documents themselves; a rate is recomputed anywhere from the posterior and the list of steps.

A pass over the documents weighs several bounds of the next step at once and keeps the best; passes end when the totals are
met to ``TOLERANCE`` of their sum or no bound brings them nearer.  ``residual``, the largest miss of a domain's expected share, is returned with
every row, and a warning says so where it is over ``WARN``: a domain without documents can't be mixed in, nor with ``max_rate`` one that has too few.

The total is set by the ``anchor`` domain: its tokens stay as many as they are, others follow by weight.  Rates are nonnegative; with
``max_rate`` they are projected to [0, max_rate]; at 1, documents are only ever thinned out (as the pipeline does, whose documents have just lost their copies).
A rate's whole part is kept copies, its fraction the chance of one more, drawn by a seeded hash of
id and text; of ``SEEDS`` seeds, tried in one pass, that whose drawn tokens are nearest to the fitted totals is taken.

Tokens are counted as words (see textops: an unspaced non-ASCII passage is one, whatever its length), or, where ``tokenizer`` names a file, as its ids with an
end id, as token files hold them; that costs as much as writing those files does.

Defined cases: null and empty texts have no words, get rates like others, and are kept by them; labels that are null are
ignored; without labels all posteriors are equal and all documents alike; rows that repeat id and text have one fate; an empty
table stays empty; columns of the documents may have any names.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import quality
from .shared import materialize
from .textops import U64, bounded_batches, buffers, mix as mix_bits, slices, trim, words_of
from .tokenfile import encoder

DOMAINS = ("low", "good", "toxic")
#: share of the tokens (words) that each domain is to have
WEIGHTS = {"low": 0.02, "good": 0.94, "toxic": 0.04}
STEPS, TOLERANCE, WARN = 60, 1e-6, 1e-3
#: bounds of a step's parts that one pass weighs, largest first
BOUNDS = (8.0, 2.0, 0.5, 0.1, 0.02, 0.004)
#: draws of the rates' fractions, of which that nearest to the targets is taken
SEEDS = 64


def domain_scorers(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[quality.Scorer]:
    """Scorers of quality and of toxicity; toxicity is told by a few words, so it looks at which words there are."""
    bounded_batches(docs.sparkSession)
    good = quality.fit(docs, labels, {"quality": F.col("quality") == 1}, max_rows=max_rows)["quality"]
    toxic = quality.fit(docs, labels.where("quality = 1"), {"toxic": F.col("toxic") == 1}, presence=True, max_rows=max_rows, l1=2.0, alpha=0.5)["toxic"]
    return [good, toxic]


def membership(scorers: list[quality.Scorer], tokenizer: str | None = None):
    """A column function: text -> struct of n (tokens) and p (posterior over DOMAINS)."""
    shared = [(s.weights, s.presence) for s in scorers]

    @arrow_udf("struct<n: long, p: array<double>>")
    def member(text: pa.Array) -> pa.Array:
        raw, offsets = buffers(text)
        p = _posteriors(shared, raw, offsets)
        n = _token_counts(raw, offsets, tokenizer)
        trim()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))], names=["n", "p"])

    return member


def _token_counts(raw: np.ndarray, offsets: np.ndarray, tokenizer: str | None) -> np.ndarray:
    found = [np.zeros(0, np.int64)]
    if tokenizer is None:
        found += [np.diff(w.offsets) for _, _, w in words_of(raw, offsets)]
    else:
        encode = encoder(tokenizer, 1)
        for i, j in slices(offsets, 2 << 20):
            a, b = int(offsets[i]), int(offsets[j])
            found.append(encode.batch(raw[a:b], offsets[i : j + 1] - a)[1])
    return np.concatenate(found)


def _posteriors(shared: list[tuple[np.ndarray, bool]], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    good, toxic = quality.probabilities([quality.Scorer(w, presence) for w, presence in shared], raw, offsets).T
    return np.stack([1 - good, good * (1 - toxic), good * toxic], axis=1)


def _rates(p: np.ndarray, steps: list[list[float]], most: float) -> np.ndarray:
    r = np.ones(len(p))
    for v in steps:
        r = np.clip(r + p @ np.array(v), 0, most)
    return r


class Fit:
    """The steps that lead from rates of 1 to the fitted rates; expected tokens by domain, and their targets."""

    def __init__(self, steps: list[list[float]], totals: np.ndarray, target: np.ndarray):
        self.steps, self.totals, self.target = steps, totals, target
        shares = [x / x.sum() if x.sum() > 0 else np.zeros(len(x)) for x in (totals, target)]
        self.residual = float(np.abs(shares[0] - shares[1]).max()) if target.sum() > 0 else 0.0


def fit_rates(members: DataFrame, weights: dict[str, float], anchor: str, max_rate: float | None, domains: tuple[str, ...] = DOMAINS) -> Fit:
    """members: n long, p array<double>."""
    k, most = len(domains), np.inf if max_rate is None else float(max_rate)
    w = np.array([weights.get(d, 0.0) for d in domains])
    w = w / w.sum()
    width = k + k * k

    def sums(steps: list[list[float]], tries: list[list[float]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each try as the next step: expected tokens by domain; second moments over the documents whose rate can still move."""

        def run(batches):
            total = np.zeros((len(tries), width))
            for batch in batches:
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                before = _rates(p, steps, most)
                for t, v in enumerate(tries):
                    r = np.clip(before + p @ np.array(v), 0, most)
                    free = n * ((r > 0) & (r < most) | (r == 1) & (len(steps) == 0) & (not any(v)))
                    total[t, :k] += (r * n) @ p
                    total[t, k:] += ((p * free[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.ravel()], names=[f"x{i}" for i in range(total.size)])

        size = len(tries) * width
        got = members.select("n", "p").mapInArrow(run, ", ".join(f"x{i} double" for i in range(size))).agg(*[F.sum(f"x{i}") for i in range(size)]).first()
        x = np.array([v or 0.0 for v in got]).reshape(len(tries), width)
        return [(row[:k], row[k:].reshape(k, k)) for row in x]

    steps: list[list[float]] = []
    now, moment = sums([], [[0.0] * k])[0]
    target = w * now[domains.index(anchor)] / max(w[domains.index(anchor)], 1e-12)
    scale = max(target.sum(), 1.0)
    miss = lambda s: float(np.sum(((s - target) / scale) ** 2))
    best = miss(now)
    for _ in range(STEPS):
        if best < TOLERANCE**2 or not moment.any():
            break
        # the step that would do if no rate met its bounds, cut to several sizes, and plain gradients of them
        gap = (target - now) / scale
        tries = [_bounded_step(moment / scale, gap, b) for b in BOUNDS] + [b * gap / max(np.abs(gap).max(), 1e-300) for b in BOUNDS[1:]]
        tries = [[round(float(x), 12) for x in v] for v in tries]
        found = sums(steps, tries)
        t = min(range(len(tries)), key=lambda i: miss(found[i][0]))
        off = miss(found[t][0])
        if off >= best * (1 - 1e-4):
            break
        best, (now, moment) = off, found[t]
        steps.append(tries[t])
    fit = Fit(steps, now, target)
    if fit.residual > WARN:
        warnings.warn(f"target shares {dict(zip(domains, w.round(4).tolist()))} can't be met: expected shares are {dict(zip(domains, (now / max(now.sum(), 1e-12)).round(4).tolist()))}", stacklevel=3)
    return fit


def _bounded_step(moment: np.ndarray, gap: np.ndarray, bound: float) -> np.ndarray:
    """The step v, each part within the bound, that brings the domain totals nearest: least |moment v - gap|."""
    m, g = moment.T @ moment + 1e-12 * np.eye(len(gap)), moment.T @ gap
    v = np.zeros(len(gap))
    for _ in range(500):
        for d in range(len(v)):
            v[d] = np.clip(v[d] + (g[d] - m[d] @ v) / m[d, d], -bound, bound)
    return v


def _copies(rates: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """Copies of documents by their rates: the whole part, and one more by a draw from the documents' keys."""
    draw = (mix_bits(keys.view(U64) ^ mix_bits(np.array([seed + 1], U64))) >> U64(11)).astype(np.float64) * 2.0**-53
    whole = np.floor(rates)
    return (whole + (draw < rates - whole)).astype(np.int64)


def draw_seed(members: DataFrame, fit: Fit, max_rate: float | None) -> int:
    """Of SEEDS draws, that whose drawn tokens are nearest to the fitted totals.  members: n long, p array<double>, key long."""
    k, most = len(fit.target), np.inf if max_rate is None else float(max_rate)

    def run(batches):
        total = np.zeros((SEEDS, k))
        for batch in batches:
            n, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            r = _rates(p, fit.steps, most)
            some = np.flatnonzero(r != np.floor(r))
            total += (n * np.floor(r)) @ p
            for seed in range(SEEDS):
                total[seed] += (n[some] * (_copies(r[some], keys[some], seed) - np.floor(r[some]))) @ p[some]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.ravel()], names=[f"x{i}" for i in range(SEEDS * k)])

    size = SEEDS * k
    got = members.select("n", "p", "key").mapInArrow(run, ", ".join(f"x{i} double" for i in range(size))).agg(*[F.sum(f"x{i}") for i in range(size)]).first()
    x = np.array([v or 0.0 for v in got]).reshape(SEEDS, k)
    return int(np.argmin(np.sum((x - fit.totals) ** 2, axis=1)))


def _key(name: Column, text: Column) -> Column:
    """What a document's draw depends on: its id and text."""
    return F.xxhash64(name, text, F.lit(11))


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str = "good", max_rate: float | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, p_low, p_good, p_toxic, rate, copies, residual of each document."""
    scorers = domain_scorers(docs, labels)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # copies depend on id and text: the draw is taken here, where the text is
    df = df.select("id", membership(scorers, tokenizer)(F.col("text")).alias("m"), _key(F.col("id"), F.col("text")).alias("key"))
    members = materialize(docs.sparkSession, df.select("id", "m.n", "m.p", "key"), "members")
    fit = fit_rates(members, weights, anchor, max_rate)
    seed, most = draw_seed(members, fit, max_rate), np.inf if max_rate is None else float(max_rate)

    @arrow_udf("struct<rate: double, copies: int>")
    def drawn(p: pa.Array, key: pa.Array) -> pa.Array:
        r = _rates(p.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS)), fit.steps, most)
        return pa.StructArray.from_arrays([pa.array(r), pa.array(_copies(r, key.to_numpy(), seed), pa.int32())], names=["rate", "copies"])

    out = members.withColumn("drawn", drawn("p", "key"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "drawn.rate", "drawn.copies", F.lit(fit.residual).alias("residual"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str = "good", max_rate: float | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The documents, each as often as mixture() says, with all their columns."""
    scorers = domain_scorers(docs, labels)
    text = F.col(text_col).cast("string")
    key = _key(F.col(id_col), text)
    members = materialize(docs.sparkSession, docs.select(membership(scorers, tokenizer)(text).alias("m"), key.alias("key")).select("m.n", "m.p", "key"), "members")
    fit = fit_rates(members, weights, anchor, max_rate)
    seed = draw_seed(members, fit, max_rate)
    shared, most = [(s.weights, s.presence) for s in scorers], np.inf if max_rate is None else float(max_rate)

    @arrow_udf("int")
    def copies(text: pa.Array, key: pa.Array) -> pa.Array:
        out = _copies(_rates(_posteriors(shared, *buffers(text)), fit.steps, most), key.to_numpy(), seed)
        trim()
        return pa.array(out, pa.int32())

    # the documents' columns are in a struct: their names don't meet those made here
    df = docs.select(F.struct("*").alias("row"), copies(text, key).alias("copies")).where("copies > 0")
    return df.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*") if max_rate is None or max_rate > 1 else df.select("row.*")
