"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (an item of fewer words is
one window).  Patterns of one length share a shift table, indexed by the hash of a block of two words:
it says how far a cursor may move because no pattern has that block nearer its end.  Where the shift
is 0, the block's hash selects a bucket of patterns, and the bytes are compared.

The documents are scanned once, by one Python step.  A benchmark of at most ``BLOCK_BYTES`` of text is broadcast with its tables, and
there is no shuffle.  A larger one stays distributed: of each pattern length only the shift table and a bitmap of the patterns' hashes are
broadcast, both of a bounded size (``MOST_BITS``) and built by tasks; the positions that pass both are joined with the patterns on
length, hash and text, as Spark joins any two tables, so no benchmark is too large and results are the same.

Defined cases: null or empty texts have no words and are never contaminated; null item texts have no
windows; items that share an id count once; null item ids are ignored in the item list (their windows
still count as hits); repeated rows each get a row of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import materialize
from .textops import U64, Words, bounded_batches, buffers, lean, mix, words_of

#: most benchmark text, in bytes, that is broadcast (its tables take about 10 x that)
BLOCK_BYTES = 16 << 20
#: logarithms of the most slots of a shift table, and of the most bits of a bitmap
MOST_BITS, MOST_MARKS = 23, 26
#: end positions that one cursor walks through.
SEGMENT = 64
_Q = U64(0x2545F4914F6CDD1D)
_GAP = re.compile(rb"\0+")
REPORT = "{id} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class _Shifts:
    """The shift table of the patterns of one length, in words."""

    def __init__(self, m: int, n: int, most_bits: int = 24):
        """For n patterns."""
        self.m, self.block = m, min(2, m)
        bits = min(most_bits, max(12, int(n * m * 8).bit_length()))
        self.down = U64(64 - bits)
        self.most = m - self.block + 1
        self.shift = np.full(1 << bits, self.most, np.uint8 if self.most < 256 else np.int64)

    def add(self, h: np.ndarray, first: np.ndarray) -> None:
        """Patterns of the words h, by their first words."""
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self.blocks(h, first + end) >> self.down, self.m - end)

    def blocks(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(h[end - 2] * _Q + h[end - 1]) if self.block == 2 else mix(h[end - 1])

    def full(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(end), U64)
        with np.errstate(over="ignore"):
            for j in range(self.m):
                out = out * _Q + h[end - self.m + j]
        return mix(out)

    @staticmethod
    def keys(suffix: np.ndarray, full: np.ndarray) -> np.ndarray:
        """The upper half is the suffix bucket, the lower half the pattern's own hash within it."""
        return (suffix & U64(0xFFFFFFFF00000000)) | (full >> U64(32))

    def ends(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(end words, keys) of the windows at which the shift is 0."""
        firsts, lasts = w.offsets[:-1] + self.m, w.offsets[1:]
        there = lasts >= firsts
        firsts, lasts = firsts[there], lasts[there]
        found = [np.zeros(0, np.int64)]
        n = (lasts - firsts) // SEGMENT + 1
        start = np.repeat(firsts, n) + SEGMENT * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(start + SEGMENT - 1, np.repeat(lasts, n))
        while len(start):
            s = self.shift[self.blocks(w.hashes, start) >> self.down].astype(np.int64)
            if (zero := s == 0).any():
                found.append(start[zero])
            start = start + np.maximum(s, 1)
            if not (on := start <= stop).all():
                start, stop = start[on], stop[on]
        end = np.sort(np.concatenate(found))
        return end, self.keys(self.blocks(w.hashes, end), self.full(w.hashes, end))

    def text_at(self, w: Words, end: int) -> bytes:
        """The words of a window, with one blank between them."""
        return _GAP.sub(b" ", bytes(w.low[w.starts[end - self.m] : w.ends[end - 1]]))


class _Length(_Shifts):
    """The patterns of one length."""

    def __init__(self, m: int, words: Words, first: np.ndarray, owner: np.ndarray):
        self.m, self.block = m, min(2, m)
        full, suffix = self.full(words.hashes, first + m), self.blocks(words.hashes, first + m)
        key = self.keys(suffix, full)
        order = np.lexsort((owner, full, key))
        key, first, owner = key[order], first[order], owner[order]
        # equal windows are one pattern with several owners; the bytes tell them apart
        text = [self.text_at(words, f + m) for f in first]
        new = np.ones(len(key), bool)
        for i in range(1, len(key)):
            new[i] = not (key[i] == key[i - 1] and text[i] == text[i - 1])
        at = np.flatnonzero(new)
        self.key, self.text = key[at], [text[i] for i in at]
        self.owned, self.owners = np.append(at, len(key)), owner
        super().__init__(m, len(at))
        self.add(words.hashes, first[at])

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(end word, pattern) of each occurrence."""
        end, key = self.ends(w)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        ends, patterns = [], []
        for i in np.flatnonzero(hi > lo):
            text = self.text_at(w, end[i])
            for p in range(lo[i], hi[i]):
                if self.text[p] == text:
                    ends.append(end[i])
                    patterns.append(p)
        return np.array(ends, np.int64), np.array(patterns, np.int64)


def _windows(texts: list[str], window: int) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """(length, words, first word of each window, item of each) of items."""
    words = Words(*buffers(pa.array(texts, pa.string())))
    size = np.diff(words.offsets)
    length = np.minimum(size, window)
    for m in sorted({*length.tolist()} - {0}):
        who = np.flatnonzero(length == m)
        n = size[who] - m + 1
        yield m, words, np.repeat(words.offsets[who], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(who, n)


class WuManber:
    """The search tables of some benchmark items, given as (id or None, text)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = 10):
        self.ids = [i for i, _ in items]
        self.lengths = [_Length(*x) for x in _windows([t for _, t in items], window)]

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words of w are inside an occurrence; the items that occur in each row that has any."""
        change = np.zeros(len(w.hashes) + 1, np.int64)
        items: dict[int, set[int]] = {}
        for x in self.lengths:
            ends, patterns = x.search(w)
            np.add.at(change, ends - x.m, 1)
            np.add.at(change, ends, -1)
            for row, p in {*zip((np.searchsorted(w.offsets, ends, "left") - 1).tolist(), patterns.tolist())}:
                items.setdefault(row, set()).update(x.owners[x.owned[p] : x.owned[p + 1]].tolist())
        return np.cumsum(change)[:-1] > 0, items


def _table(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> WuManber | None:
    """The search tables of a benchmark that is small enough to be broadcast."""
    items = benchmark.select(F.col(item_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    size, n = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)), F.count("*")).first()
    return WuManber([tuple(r) for r in items.collect()], window) if size + n * ITEM_BYTES <= BLOCK_BYTES else None


#: bytes that an item counts for besides its text
ITEM_BYTES = 16


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    bounded_batches(spark)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    table = _table(benchmark, item_col, item_text_col, window)
    if table is not None:
        return df.mapInArrow(_scan(spark.sparkContext.broadcast(table)), REPORT.format(id="id", kind=kind)).withColumnRenamed("id", id_col)
    patterns, sieves = _distributed(benchmark, item_col, item_text_col, window)
    found = df.mapInArrow(_passing(sieves, 1), f"row struct<id: {kind}, text: string>, n_words long, windows {_WINDOWS}")
    # a row's number holds for what is written here, whatever becomes of its tasks
    found = materialize(spark, found.select("row.id", "n_words", "windows").withColumn("number", F.monotonically_increasing_id()), "windows")
    windows = found.select("number", F.explode("windows").alias("w")).select("number", "w.*")
    hits = windows.join(patterns.select("m", "key", "pattern").distinct(), ["m", "key", "pattern"], "left_semi").select("number", F.explode(F.sequence(F.col("end") - F.col("m"), F.col("end") - 1)).alias("word"))
    hits = hits.distinct().groupBy("number").agg(F.count("*").alias("n_hit"))
    items = windows.drop("end").distinct().join(patterns, ["m", "key", "pattern"]).where("item is not null").select("number", "item").distinct()
    items = items.groupBy("number").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    out = found.select("id", "n_words", "number").join(hits, "number", "left").join(items, "number", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _scan(table):
    def scan(batches):
        t = table.value
        for batch in batches:
            n_words, n_hit, names = [], [], []
            for i, j, w in words_of(*buffers(batch.column(1))):
                hit, items = t.hits(w)
                count = np.concatenate([[0], np.cumsum(hit)])
                n_words += np.diff(w.offsets).tolist()
                n_hit += (count[w.offsets[1:]] - count[w.offsets[:-1]]).tolist()
                names += [sorted({t.ids[k] for k in items[r]} - {None}) if r in items else [] for r in range(j - i)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
                names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return lean(scan)


_WINDOWS = "array<struct<end: long, m: int, key: long, pattern: binary>>"
_STRUCT = pa.struct([("end", pa.int64()), ("m", pa.int32()), ("key", pa.int64()), ("pattern", pa.binary())])


def _distributed(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, object]:
    """Patterns as a table (m, key, pattern, item); and for each length the broadcast shift table and bitmap of keys."""
    spark = benchmark.sparkSession

    def cut(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for m, words, first, owner in _windows(batch.column(1).fill_null("").to_pylist(), window):
                s = _Shifts(m, 1)
                key = s.keys(s.blocks(words.hashes, first + m), s.full(words.hashes, first + m))
                for k in range(0, len(first), 8192):
                    part = slice(k, k + 8192)
                    text = [s.text_at(words, f + m) for f in first[part]]
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(text), pa.int32()), pa.array(key[part].view(np.int64)), pa.array(text, pa.binary()), pa.array([names[o] for o in owner[part]], pa.string())], names=["m", "key", "pattern", "item"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    patterns = materialize(spark, items.mapInArrow(lean(cut), "m int, key long, pattern binary, item string").distinct(), "patterns")
    sizes = {r.m: r["count"] for r in patterns.groupBy("m").count().collect()}

    def empty(m: int) -> tuple[_Shifts, np.ndarray]:
        return _Shifts(m, sizes[m], MOST_BITS), np.zeros(1 << max(0, min(MOST_MARKS, max(15, (sizes[m] * 16).bit_length())) - 3), np.uint8)

    def sieve(batches):
        made: dict[int, tuple[_Shifts, np.ndarray]] = {}
        for batch in batches:
            lengths, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
            for m in np.unique(lengths).tolist():
                shifts, marks = made.setdefault(m, empty(m))
                own = np.flatnonzero(lengths == m)
                words = Words(*buffers(batch.column(2).cast(pa.string()).take(pa.array(own))))
                shifts.add(words.hashes, words.offsets[:-1])
                _mark(marks, keys[own])
        yield from _tables(made)

    def merge(batches):
        made: dict[int, tuple[_Shifts, np.ndarray]] = {}
        for batch in batches:
            for m, shift, marks in zip(*(c.to_pylist() for c in batch.columns)):
                own = made.setdefault(m, empty(m))
                np.minimum(own[0].shift, np.frombuffer(shift, own[0].shift.dtype), out=own[0].shift)
                np.bitwise_or(own[1], np.frombuffer(marks, np.uint8), out=own[1])
        yield from _tables(made)

    kind = "m int, shift binary, marks binary"
    tables = patterns.mapInArrow(lean(sieve), kind).repartition("m").mapInArrow(lean(merge), kind).collect()
    found = []
    for r in sorted(tables, key=lambda r: r.m):
        shifts, _ = empty(r.m)
        shifts.shift = np.frombuffer(r.shift, shifts.shift.dtype)
        found.append((shifts, np.frombuffer(r.marks, np.uint8)))
    return patterns, spark.sparkContext.broadcast(found)


def _tables(made: dict) -> Iterator[pa.RecordBatch]:
    for m, (shifts, marks) in made.items():
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([shifts.shift.tobytes()], pa.binary()), pa.array([marks.tobytes()], pa.binary())], names=["m", "shift", "marks"])


def _spot(marks: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bit = mix(keys) >> U64(64 - (len(marks) * 8 - 1).bit_length())
    return (bit >> U64(3)).astype(np.int64), np.left_shift(1, (bit & U64(7)).astype(np.int64)).astype(np.uint8)


def _mark(marks: np.ndarray, keys: np.ndarray) -> None:
    byte, bit = _spot(marks, keys)
    np.bitwise_or.at(marks, byte, bit)


def _passing(sieves, at: int):
    """Rows with their number of words and the windows that pass shift table and bitmap; the text is column at."""

    def scan(batches):
        for batch in batches:
            count, windows = [], []
            for i, j, w in words_of(*buffers(batch.column(at))):
                count += np.diff(w.offsets).tolist()
                own: list[list[dict]] = [[] for _ in range(j - i)]
                for shifts, marks in sieves.value:
                    end, key = shifts.ends(w)
                    byte, bit = _spot(marks, key)
                    on = np.flatnonzero(marks[byte] & bit)
                    row = np.searchsorted(w.offsets, end[on], "left") - 1
                    for r, e, k in zip(row.tolist(), end[on].tolist(), key[on].view(np.int64).tolist()):
                        own[r].append({"end": e - int(w.offsets[r]), "m": shifts.m, "key": k, "pattern": shifts.text_at(w, e)})
                windows += own
            row = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            yield pa.RecordBatch.from_arrays([row, pa.array(count, pa.int64()), pa.array(windows, pa.list_(_STRUCT))], names=["row", "n_words", "windows"])

    return lean(scan)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    bounded_batches(spark)
    table = _table(benchmark, item_col, item_text_col, window)
    if table is not None:
        return docs.mapInArrow(_clean(spark.sparkContext.broadcast(table), at), docs.schema)
    patterns, sieves = _distributed(benchmark, item_col, item_text_col, window)
    kind = T.StructType([T.StructField("row", docs.schema), *T._parse_datatype_string(f"n_words long, windows {_WINDOWS}")])
    found = materialize(spark, docs.mapInArrow(_passing(sieves, at), kind).withColumn("number", F.monotonically_increasing_id()), "windows")
    windows = found.select("number", F.explode("windows").alias("w")).select("number", "w.*")
    hit = windows.join(patterns.select("m", "key", "pattern").distinct(), ["m", "key", "pattern"], "left_semi").select("number").distinct()
    return found.select("number", "row").join(hit, "number", "left_anti").select("row.*")


def _clean(table, at: int):
    def scan(batches):
        t = table.value
        for batch in batches:
            mask = np.ones(batch.num_rows, bool)
            for i, _, w in words_of(*buffers(batch.column(at))):
                mask[[i + r for r in t.hits(w)[1]]] = False
            yield batch.filter(pa.array(mask))

    return lean(scan)
