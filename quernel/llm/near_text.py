"""MinHash near-dedup of documents: DartMinHash signatures of weighted word shingles, banded joining.

Texts with the same words form a class (copies); each class has one signature of ``k`` darts and ``k / rows``
bands.  Classes that share a band are candidates unless the share of their equal darts, which estimates the weighted Jaccard similarity, is under half of
``threshold`` (over five standard deviations off).  Candidates link at a weighted Jaccard similarity of ``threshold`` or more, counted over all
their shingles (of 32-bit hashes: two texts of n and m shingles have n m / 2^32 too many in common).  At the threshold itself, a pair shares a band
with a chance of 0.99, at 0.5 of 0.998.  A document's ``n_links`` counts the documents of its class and
of the linked classes; ``component_id`` is the least id reachable by links.

Defined cases: texts without words (null, empty) link with nothing and are kept; repeated rows of an id are copies
of each other, and all rows with the kept id and text are kept; a null id sorts before others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .links import SALTS, bucket_links, components, distinct_reps, with_least
from .minhash import occurrences, overlaps, shingles, signatures
from .shared import materialize
from .textops import U64, bounded_batches, buffers, lean, mix, trim, words_of

#: darts of a signature, darts of a band, words of a shingle, least similarity of a link
K, ROWS, SHINGLE, THRESHOLD = 144, 3, 2, 0.45


def _class_keys(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Two 64-bit hashes of each row's word sequence; and which rows have words."""
    raw, offsets = buffers(column)
    keys: list[list[np.ndarray]] = [[], []]
    some = []
    for _, _, w in words_of(raw, offsets):
        n = len(w.hashes)
        row = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
        at = (np.arange(n) - w.offsets[row]).astype(U64)
        for seed, out in enumerate(keys):
            with np.errstate(over="ignore"):
                total = np.zeros(n + 1, U64)
                np.cumsum(mix(w.hashes + mix(at + U64(seed * 0x51ED27 + 11))), out=total[1:])
                out.append(mix(total[w.offsets[1:]] - total[w.offsets[:-1]]))
        some.append(np.diff(w.offsets) > 0)
    none = np.zeros(0, U64)
    return [np.concatenate(x) if x else none for x in keys], np.concatenate(some) if some else np.zeros(0, bool)


def _sign(k: int, rows: int, size: int):
    def run(batches):
        for batch in batches:
            keys, some = _class_keys(batch.column(1))
            raw, offsets = buffers(batch.column(1))
            sign, bands = [], []
            for _, _, w in words_of(raw, offsets):
                s = signatures(*shingles(w.hashes, w.offsets, size), k)
                with np.errstate(over="ignore"):
                    b = np.zeros((len(s), k // rows), U64)
                    for r in range(rows):
                        b = mix(b * U64(0x9E3779B97F4A7C15) + s[:, r::rows])
                    bands.append(mix(b + np.arange(k // rows, dtype=U64)).view(np.int64))
                sign.append((s >> U64(40)).astype(np.uint16))
            sign = np.concatenate(sign) if sign else np.zeros((0, k), np.uint16)
            bands = np.concatenate(bands) if bands else np.zeros((0, k // rows), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x.view(np.int64), mask=~some) for x in keys], pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, k // rows), pa.int32()), pa.array(bands.ravel())), pa.array([x.tobytes() for x in sign], pa.binary())],
                names=["id", "h1", "h2", "keys", "payload"],
            )

    return run


def _verify(threshold: float):
    def verify(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(y)), bool)
        step = max(1, (1 << 22) // max(1, len(y) * x.shape[1]))
        for i in range(0, len(x), step):
            out[i : i + step] = (x[i : i + step, None] == y[None]).mean(axis=2) >= threshold
        return out

    return verify


def _verify_long(threshold: float):
    def verify(raw: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        cells, offsets = raw[at[0] : at[-1]].view(np.uint32), (at - at[0]) // 4
        common, n = overlaps(cells, offsets), np.diff(offsets)
        return (common / (n[:, None] + n - common) >= threshold)[np.ix_(left, right)]

    return verify


def _cells(size: int):
    """Of texts with words: h1 and h2 of the class and the 32-bit hashes of its occurrences of shingles, equal ones once."""

    def run(batches):
        for batch in batches:
            keys, some = _class_keys(batch.column(0))
            raw, offsets = buffers(batch.column(0))
            cells: list[bytes] = []
            for _, _, w in words_of(raw, offsets):
                e, cell, row = occurrences(*shingles(w.hashes, w.offsets, size))
                with np.errstate(over="ignore"):
                    x = (mix(e + mix(cell.astype(U64))) >> U64(32)).astype(np.uint32)
                at = np.searchsorted(row, np.arange(len(w.offsets)))
                cells += [np.unique(x[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64), mask=~some) for x in keys], pa.array(cells, pa.binary())], names=["h1", "h2", "payload"])

    return run


def _groups(docs: DataFrame, id_col: str, text_col: str, k: int, rows: int, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Every document as (id, h1, h2); the classes that have copies or links as (h1, h2, first, n_links, root)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signed = materialize(spark, texts.mapInArrow(lean(_sign(k, rows, shingle)), f"id {kind}, h1 long, h2 long, keys array<long>, payload binary"), "signed")
    # all copies have one signature, so the first of each map task stands for them
    classes = signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("payload").alias("payload"))
    classes = distinct_reps(materialize(spark, classes, "classes"))

    def payloads(reps: DataFrame) -> DataFrame:
        cells = texts.select("text").mapInArrow(lean(_cells(shingle)), "h1 long, h2 long, payload binary").where("h1 is not null")
        wanted = classes.select("rep", "h1", "h2", "copies", "keys").join(reps, "rep")
        # of the copies of a class one is wanted: the first of each task before the shuffle, however many there are
        return cells.join(wanted.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("payload").alias("payload")).join(wanted, ["h1", "h2"]).select("rep", "copies", "keys", "payload")

    linked, edges = bucket_links(spark, classes.select("rep", "keys", F.col("payload").alias("sketch")), _verify(threshold / 2), "uint16", payloads, _verify_long(threshold))
    root = components(spark, edges)
    groups = classes.select("h1", "h2", "rep", "first", "copies").join(linked, "rep", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or linked is not null")
    groups = with_least(materialize(spark, groups.withColumn("root", F.coalesce("root", "rep")), "groups"))
    n_links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    return signed.select("id", "h1", "h2"), groups.select("h1", "h2", "first", n_links.alias("n_links"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows: int = ROWS, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least id of its copies), n_links, component_id, kept for each document."""
    member, groups = _groups(docs, id_col, text_col, k, rows, shingle, threshold)
    member = member.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    df = member.join(groups, ["h1", "h2", "salt"], "left")
    lone = F.col("component_id").isNull() & F.col("n_links").isNull()
    component = F.when(lone, F.col("id")).otherwise(F.col("component_id"))
    return df.select(
        F.col("id").alias(id_col),
        F.when(lone, F.col("id")).otherwise(F.col("first")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows: int = ROWS, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group of copies and near copies, that of the least id; with all columns.

    Rows that repeat an id and its text are one group too: one of them stays.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<h1: long, h2: long>")
    def class_of(text: pa.Array) -> pa.Array:
        keys, some = _class_keys(text)
        trim()
        return pa.StructArray.from_arrays([pa.array(x.view(np.int64), mask=~some) for x in keys], names=["h1", "h2"])

    member, groups = _groups(docs, id_col, text_col, k, rows, shingle, threshold)
    groups = materialize(docs.sparkSession, groups, "kept")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    member = member.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(salted, ["h1", "h2", "salt"])
    dropped = member.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("d_id"), F.col("h1").alias("d_h1"), F.col("h2").alias("d_h2")).distinct()
    # the documents' columns are in a struct: their names don't meet those made here
    df = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), class_of(F.col(text_col).cast("string")).alias("class")).select("row", "id", "class.h1", "class.h2")
    same = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("h1") == F.col("d_h1")) & (F.col("h2") == F.col("d_h2"))
    df = df.join(dropped, same, "left_anti")
    again = member.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("h1", "h2", "id").count().where("count > 1")
    if not again.isEmpty():
        df = df.where("h1 is null").unionByName(df.where("h1 is not null").dropDuplicates(["id", "h1", "h2"]))
    return df.select("row.*")
