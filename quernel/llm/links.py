"""Links within buckets, and connected components of them, without pairs ever being shuffled.

Near-duplicate operators put each class of equal items (one representative, with its number of copies) in
buckets; two representatives may link if they share one.  Buckets with the same members are looked at once.  A
bucket of more than ``BLOCK`` members is cut into blocks, and each pair of blocks is a tile of its own:
a task holds at most two blocks, however hot a bucket.  A tile compares its members as matrices and returns,
per member, how many rows it links with and the least member of its group in the tile: rows in proportion to members.
A pair that shares several buckets counts in the one with the least key only.

Two looks: first, only short sketches go to the tiles, and find the members that may link; then those members alone are fetched with all
that the verdict needs (payload, copies, and such keys as are less than the tile's), and only their tiles are formed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import materialize
from .textops import lean

#: members of a block; a tile holds two.
BLOCK = 1024
#: copies of one class may be a third of all rows, a component may hold a third of all classes: their joins with one row of it are spread over so many keys
SALTS = 16
#: (sketches of some members, of others) -> whether each pair may link
Verify = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: (bytes of all members' payloads, where each begins, some members, others) -> whether each pair links
VerifyLong = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def bucket_links(spark: SparkSession, items: DataFrame, verify: Verify, dtype: str, payloads: Callable[[DataFrame], DataFrame], verify_long: VerifyLong) -> tuple[DataFrame, DataFrame]:
    """items: rep long (unique), keys array<long> (distinct), sketch binary of numbers of dtype, equally many for all in a bucket.

    payloads takes a table of distinct rep to their (rep, copies long, keys, payload binary), for verify_long.
    Returns (rep, linked: rows of other representatives that rep links with) and edges (big, small)
    that connect what is linked.
    """
    rows = items.select("rep", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.min("rep").alias("lo")).where("n > 1")
    # buckets with the same members: the one of the least key stands for all
    buckets = shared.groupBy("n", "who", "lo").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    tiles = rows.join(buckets.select("key", blocks.alias("c")), "key").withColumn("a", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("c")).cast("int"))
    tiles = tiles.select("key", "rep", "a", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("b")).select("key", "rep", "a", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    short = tiles.join(items.select("rep", "sketch"), "rep").select("key", "i", "j", "a", "rep", "sketch")
    maybe = _by_tile(short).mapInArrow(lean(_tiles(_some(matrix(verify, dtype)))), "key long, i int, j int, a int, rep long")
    maybe = materialize(spark, maybe, "maybe")
    full = maybe.join(payloads(maybe.select("rep").distinct()), "rep")
    full = full.select("key", "i", "j", "a", "rep", "payload", "copies", F.expr("filter(keys, k -> k < key)").alias("keys"))
    found = _by_tile(full).mapInArrow(lean(_tiles(_links(verify_long))), "rep long, linked long, lead long")
    found = materialize(spark, found, "links")
    edges = found.where("rep <> lead").select(F.greatest("rep", "lead").alias("big"), F.least("rep", "lead").alias("small")).distinct()
    return found.groupBy("rep").agg(F.sum("linked").alias("linked")), edges


def distinct_reps(classes: DataFrame) -> DataFrame:
    """classes (of distinct h1, h2) with a distinct rep: h1, and in the rare case that classes share it a hash of both."""
    clash = classes.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1", F.lit(True).alias("clash"))
    if clash.isEmpty():
        return classes.withColumn("rep", F.col("h1"))
    marked = classes.join(clash, "h1", "left")
    return marked.withColumn("rep", F.when(F.col("clash"), F.xxhash64("h1", "h2", F.lit(5))).otherwise(F.col("h1"))).drop("clash")


def with_least(groups: DataFrame) -> DataFrame:
    """groups (root, rep, first) with component_id, the least first of its root; salted, as a component may be most of all."""
    least = groups.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return groups.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).drop("salt")


def _by_tile(full: DataFrame) -> DataFrame:
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")


def matrix(verify: Verify, dtype: str) -> VerifyLong:
    """verify for payloads of equally many numbers of dtype."""

    def run(raw: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = raw[at[0] : at[-1]].view(dtype).reshape(len(at) - 1, -1)
        return verify(x[left], x[right])

    return run


def _tiles(held_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            spot = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cut = np.flatnonzero((spot[1:] != spot[:-1]).any(axis=1)) + 1
            if last is not None and (spot[0] != last).any():
                yield from held_of(held)
                held = []
            if len(cut):
                held.append(batch.slice(0, int(cut[-1])))
                yield from held_of(held)
                held = [batch.slice(int(cut[-1]))]
            else:
                held.append(batch)
            last = spot[-1]
        yield from held_of(held)

    return run


def _pairs(t: pa.Table, linking) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, members, members that they link with) of the complete tiles in a table."""
    key, i, j, a = (t.column(k).to_numpy() for k in range(4))
    data = t.column(5).chunk(0)
    data_at = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8)
    cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    for p, q in zip(np.append(0, cut), np.append(cut, len(key))):
        if i[p] == j[p]:
            left = right = np.arange(q - p)
        else:
            left, right = np.flatnonzero(a[p:q] == i[p]), np.flatnonzero(a[p:q] == j[p])
        if not len(left) or not len(right):
            continue
        u, v = np.nonzero(linking(raw, data_at[p : q + 1], left, right))
        if i[p] == j[p]:
            u, v = u[u < v], v[u < v]
        if len(u):
            yield p, q, left[u], right[v]


def _some(linking):
    """Of complete tiles, the members that may link."""

    def run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            some = [p + np.unique(np.concatenate([u, v])) for p, _, u, v in _pairs(t, linking)]
            if some:
                yield from t.select(range(5)).take(pa.array(np.concatenate(some))).combine_chunks().to_batches()

    return run


def _links(linking):
    """Of complete tiles, each linked member's rows that it links with and least member of its group."""

    def run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        key, rep, copies = (t.column(k).to_numpy() for k in (0, 4, 6))
        keys = t.column(7).chunk(0)
        key_at, key_of = keys.offsets.to_numpy(), keys.values.to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for p, q, u, v in _pairs(t, linking):
            own = [key_of[key_at[r] : key_at[r + 1]] for r in range(p, q)]
            new = ~_earlier(own, u, v)
            linked = np.zeros(q - p, np.int64)
            np.add.at(linked, u[new], copies[p + v[new]])
            np.add.at(linked, v[new], copies[p + u[new]])
            lead = np.arange(q - p)
            while True:
                least = np.minimum(lead[u], lead[v])
                before = lead.copy()
                np.minimum.at(lead, u, least)
                np.minimum.at(lead, v, least)
                if (before == lead).all():
                    break
            some = np.unique(np.concatenate([u, v]))
            out[0].append(rep[p + some])
            out[1].append(linked[some])
            out[2].append(rep[p + lead[some]])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["rep", "linked", "lead"])

    return run


def _earlier(own: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether members u and v share a key less than the tile's."""
    if len(u) <= 8:
        return np.array([(own[a][:, None] == own[b]).any() for a, b in zip(u, v)], bool)
    who = np.repeat(np.arange(len(own)), [len(k) for k in own])
    keys = np.concatenate(own)
    names, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = count > 1
    if not twice.any():
        return np.zeros(len(u), bool)
    seat = np.cumsum(twice) - 1
    on = twice[at]
    has = np.zeros((len(own), int(twice.sum())), np.float32)
    has[who[on], seat[at[on]]] = 1
    return (has @ has.T)[u, v] > 0


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (big > small), root the least node of its component.

    Alternating large-star and small-star rounds until every edge points to a root; each round's
    edges are written to the shared folder.
    """
    edges, before = materialize(spark, edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("small").alias("big"), F.col("big").alias("small")))
        least = both.groupBy("big").agg(F.least(F.min("small"), F.first("big")).alias("lo"))
        large = both.join(least, "big").where("small > big").select(F.col("small").alias("big"), F.col("lo").alias("small")).where("big <> small").distinct()
        least = large.groupBy("big").agg(F.min("small").alias("lo"))
        small = large.join(least, "big").select(F.explode(F.array(F.struct("big", F.col("lo").alias("small")), F.struct(F.col("small").alias("big"), F.col("lo").alias("small")))).alias("e")).select("e.*").where("big <> small").distinct()
        edges = materialize(spark, small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(edges.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct())
