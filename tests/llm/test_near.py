"""Near-duplicates of vectors and texts, against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quernel.llm import links, near_text, near_vectors
from quernel.llm.minhash import overlaps, shingles, signatures
from quernel.llm.textops import Words, buffers


def brute_vectors(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    near = [[i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= threshold for j in range(len(rows))] for i in range(len(rows))]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if near[i][j] and root[j] < root[i]:
                    root[i], changed = root[j], True
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], sum(near[i]), least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [512, 4])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    rng = np.random.RandomState(3)
    rows = []
    for c in range(12):
        center = rng.standard_normal(16)
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows), (center + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3])).astype("f4").tolist()))
    rows += [(900 + i, v) for i, v in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [1e30] * 16, [1e-30] * 16])]
    rows.append((rows[3][0], rows[4][1]))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rep", T.StringType()), T.StructField("v", T.LongType())])
    got = near_vectors.near_duplicates(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], schema)).collect()
    as32 = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == brute_vectors(as32)


def test_no_vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    assert near_vectors.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in near_vectors.near_duplicates(spark.createDataFrame([(1, None)], schema)).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize(("n", "pairs"), [(1000, 2000), (50_000, 2000), (1_000_000, 2000), (100_000_000, 300), (1_000_000_000, 150)])
def test_filter_recall_at_the_threshold(n, pairs):
    f, rng = near_vectors.Filters(64, n), np.random.RandomState(0)
    x = rng.standard_normal((pairs, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((pairs, 64))
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    found = [len(np.intersect1d(a, b)) > 0 for a, b in zip(f.decode(x), f.decode(0.9 * x + math.sqrt(0.19) * z))]
    assert np.mean(found) > 0.99


def test_sketches_lose_no_link():
    rng = np.random.RandomState(1)
    x = rng.standard_normal((300, 24)) * 10.0 ** rng.randint(-2, 3, (300, 24))  # few large components: rounding takes much away
    x = np.concatenate([x, x + rng.standard_normal((300, 24)) * np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0, 0.2, (300, 1))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s, near = near_vectors.sketches(unit), near_vectors.cosines(x, x) >= 0.9
    may = near_vectors.may_link(0.9)(s, s)
    assert near.sum() > 700 and not (near & ~may).any() and may.sum() < 1.3 * near.sum()


def test_classes_that_share_a_hash(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 2, "c"), (3, 1, "d")]
    got = {r.name: r.rep for r in links.distinct_reps(spark.createDataFrame(rows, "h1 long, h2 long, name string")).collect()}
    assert len(set(got.values())) == 4 and (got["c"], got["d"]) == (2, 3)


def signs(texts):
    return np.concatenate([signatures(*shingles(w.hashes, w.offsets, near_text.SHINGLE), near_text.K) for w in [Words(*buffers(pa.array(texts, pa.string())))]])


def jaccard(a, b, size=2):
    from collections import Counter

    grams = [Counter(tuple(t.split()[i : i + size]) for i in range(max(1, len(t.split()) - size + 1))) for t in (a, b)]
    return sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values())


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(400)]
    texts = []
    for share in (0.0, 0.05, 0.1, 0.2, 0.4, 0.8):
        t = base[:]
        for i in range(len(t)):
            if rng.random() < share:
                t[i] = f"new{rng.randint(0, 999)}"
        texts.append(" ".join(t))
    texts.append(" ".join(base * 2))
    s = signs(texts)
    for i in range(len(texts)):
        assert abs((s[0] == s[i]).mean() - jaccard(texts[0], texts[i])) < 0.13
    assert (signs([texts[3]])[0] == s[3]).all(), "a signature doesn't depend on the batch"


def test_every_coordinate_is_filled():
    assert (signs(["one", "one two", "x " * 5000]) != 0).all()


def make_corpus(rng):
    rows = []
    for g in range(6):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 7)):
            t = base[:]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 999)}"
            rows.append((len(rows) * 3 + 1, " ".join(t)))
    return rows


def brute_texts(rows):
    clean = [" ".join(t.split()) if t else "" for _, t in rows]
    s = (signs(clean) >> np.uint64(40)).astype(np.uint16)
    some = [bool(c) for c in clean]
    near = [[i != j and some[i] and some[j] and (clean[i] == clean[j] or (s[i] == s[j]).mean() >= near_text.THRESHOLD) for j in range(len(rows))] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in range(len(rows)) if near[i][j])]) for i in range(len(rows))]
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    return sorted((rows[i][0], sum(near[i]), least[root[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [512, 2])
def test_texts_against_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    rows = make_corpus(random.Random(5))
    rows += [(501, rows[0][1]), (502, rows[0][1].upper() + "!"), (503, ""), (504, None), (505, "")]
    lower = [(i, t.lower().replace("!", "") if t else t) for i, t in rows]
    got = near_text.near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got) == brute_texts(lower)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_text.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def edited(rng, share, size):
    """A text and a copy of it with a passage put in, so that their similarity is about the share."""
    base = [f"w{rng.randint(0, 30_000)}" for _ in range(size)]
    at, new = rng.randrange(size), [f"n{rng.randint(0, 30_000)}" for _ in range(round(size / share) - size)]
    return " ".join(base), " ".join(base[:at] + new + base[at:])


def test_recall_of_edited_copies(docs_of):
    rng, rows, want = random.Random(4), [], []
    for i in range(300):
        a, b = edited(rng, rng.uniform(0.4, 0.7), rng.randint(40, 200))
        rows += [(2 * i, a), (2 * i + 1, b)]
        want.append(jaccard(a, b))
    got = {r.doc_id: r for r in near_text.near_duplicates(docs_of(rows)).collect()}
    linked = [got[2 * i + 1].component_id == 2 * i for i in range(300)]
    over = [x for x, j in zip(linked, want) if j >= near_text.THRESHOLD]
    assert len(over) > 200 and sum(over) / len(over) > 0.985
    assert not any(x for x, j in zip(linked, want) if j < near_text.THRESHOLD), "links are exact"
    assert [r.n_links for r in got.values()].count(1) == 2 * sum(linked)


def test_overlaps_of_many_rows():
    rng = np.random.RandomState(2)
    rows = [np.unique(rng.randint(0, 300, rng.randint(0, 90))).astype(np.uint32) for _ in range(60)]
    got = overlaps(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert all(got[i, j] == len(np.intersect1d(rows[i], rows[j])) for i in range(60) for j in range(60) if i != j)


def test_edge_texts(edge_docs, docs_of):
    got = near_text.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_links for r in by[0]] == [0] and by[0][0].kept and [r.n_links for r in by[4]] == [2, 2]
    assert by[5][0].component_id == 4 and not by[5][0].kept and by[None][0].kept
    kept = [r.doc_id for r in near_text.keep_one(edge_docs).collect()]
    assert kept.count(4) == 1 and 5 not in kept and kept.count(3) == 2 and None in kept
    assert near_text.near_duplicates(docs_of([])).collect() == [] == near_text.keep_one(docs_of([])).collect()


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(i + 1, i) for i in range(100, 103)] + [(k, 200) for k in range(201, 230)]
    got = links.components(spark, spark.createDataFrame(edges, "big long, small long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)} | {i: 200 for i in range(200, 230)}
    assert {r.node: r.root for r in got} == want
