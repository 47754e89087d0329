"""Token files: documents as one array of ids, their boundaries Elias-Fano encoded.

A file holds the token ids of its documents one after another (2 bytes each where the vocabulary allows, else
4), the documents' end offsets and their ids (less the least) as Elias-Fano sequences, and a footer.  Of such a sequence the low bits of each value are packed, the
high bits in unary in a bit vector, of which every ``SAMPLE``-th set bit's place is stored; ``select`` then
returns any value in constant time, or a range of them, without a table of all.  That is about 2 + log2(tokens per document) bits a document for the ends, and as much for dense ids.

Documents go to files in ascending id order: one range shuffle of the texts, then each task encodes and streams its
range into its file.  Only files named in the manifest count, so retried tasks leave no trace in the result.

Defined cases: null texts are empty and have the end id alone; rows that repeat an id are in order of their text's
hash, then text; null ids come first; an empty table writes no file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import filesystem, new_dir
from .textops import U64, bounded_batches, buffers, lean, slices, span_hashes

MAGIC = b"QTOKENS2"
#: magic, bytes an id, documents, ids, documents without an id (they come first), least id; then of the ends and of the ids: low bits, words of the high bit vector, samples
_HEAD = "<8sqqqqq6q"
SAMPLE = 64
#: documents whose boundaries are read at once; ids that one reading task takes, about
RANGE, TASK_IDS = 4096, 64 << 20
#: about so many bytes of text go to one file
FILE_BYTES = 32 << 20


class EliasFano:
    """A non-decreasing sequence of n non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(-(-n * low_bits // 64) + 1, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((int(ones[-1]) + 1 if n else 0) + 63) // 64 * 64, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view(np.uint64), ones[::SAMPLE].astype(np.uint64))

    def __len__(self) -> int:
        return self.n

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > 64
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, over whole words of the bit vector, to the bit."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = at // 64
        bits = int(self.high[word]) >> (at % 64) << (at % 64)
        while (here := bits.bit_count()) <= left:
            left -= here
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        return (place - i << self.low_bits) | int(self._low(np.array([i]))[0])

    def select_range(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1: from the sample before the first, over the words of the bit vector up to the sample after the last."""
        if i >= j:
            return np.zeros(0, np.uint64)
        k = i // SAMPLE
        after = -(-j // SAMPLE)
        begin = int(self.samples[k]) // 64
        end = int(self.samples[after]) // 64 + 1 if after < len(self.samples) else len(self.high)
        ones = begin * 64 + np.flatnonzero(np.unpackbits(self.high[begin:end].view(np.uint8), bitorder="little"))
        ones = ones[np.searchsorted(ones, int(self.samples[k])) + i - k * SAMPLE :][: j - i]
        at = np.arange(i, j)
        return ((ones - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def all(self) -> np.ndarray:
        return self.select_range(0, self.n)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.low, self.high, self.samples


class TokenFile:
    """A token file, opened for reading."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        magic, self.width, self.n_docs, self.n_ids, self.nulls, self.least, *shape = struct.unpack(_HEAD, self.file.read_at(struct.calcsize(_HEAD), self.size - struct.calcsize(_HEAD)))
        assert magic == MAGIC, "not a token file"
        at = self.n_ids * self.width
        found = []
        for n, (low_bits, words, samples) in zip((self.n_docs, self.n_docs - self.nulls), (shape[:3], shape[3:])):
            parts = []
            for size in (-(-n * low_bits // 64) + 1, words, samples):
                parts.append(np.frombuffer(self.file.read_at(size * 8, at), np.uint64, size))
                at += size * 8
            found.append(EliasFano(n, low_bits, *parts))
        self.ends, self.ids_of = found

    def doc_ids(self, i: int, j: int) -> pa.Array:
        """Ids of documents i to j - 1."""
        nulls = max(0, min(j, self.nulls) - i)
        some = self.ids_of.select_range(max(0, i - self.nulls), j - self.nulls) if j > self.nulls else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            some = (some + np.array(self.least, np.int64).astype(np.uint64)).view(np.int64)
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(some)])

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), np.uint16 if self.width == 2 else np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.span(i))


_PIECE = re.compile(r"[^ \n]+")

#: per byte: 0 not plain, 1 blank, 2 letter, 3 digit, 4 other visible character
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 4
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = 1
_CLASS[0x30:0x3A] = 3
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: the splitting rule and the steps before it for which plain texts are split here
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, which rows are plain) of the tokens that _SPLIT finds.

    Plain rows hold printable ASCII, blanks, and the letters of Latin-1 from U+00C0, for which lower-casing and NFC
    work character by character, and no "<|" with which special tokens begin.
    """
    kind, low = _CLASS[raw], _LOWER[raw]
    lead = raw == 0xC3
    after = np.zeros(len(raw), bool)
    after[1:] = lead[:-1]
    accent = after & (raw >= 0x80) & (raw <= 0xBF) & (raw != 0x97) & (raw != 0xB7)
    low[accent & (raw <= 0x9E)] += 0x20
    kind[accent] = 2
    good_lead = np.zeros(len(raw), bool)
    good_lead[:-1] = accent[1:]
    kind[lead & good_lead] = 2
    bad = kind == 0
    bad[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    plain = np.diff(np.concatenate([[0], np.cumsum(bad)])[offsets]) == 0
    size = np.diff(offsets)
    kind[np.repeat(~plain, size)] = 1
    first = np.ones(len(raw), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    first[offsets[:-1][size > 0]] = True
    # an apostrophe that begins a run takes the letters of a contraction from the word after it
    row_end = np.repeat(offsets[1:], size)
    at = np.flatnonzero((raw == 0x27) & first & (kind == 4))
    at = at[at + 1 < row_end[at]] if len(at) else at
    at = at[(kind[at + 1] == 2) & first[at + 1]]
    if len(at):
        a = low[at + 1]
        two = np.minimum(at + 2, len(raw) - 1)
        b = np.where((at + 2 < row_end[at]) & (kind[two] == 2), low[two], 0)
        take = np.isin(a, np.frombuffer(b"stmd", np.uint8)).astype(int)
        take[((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))] = 2
        at, take = at[take > 0], take[take > 0]
        first[at + 1] = False
        end = at + 1 + take
        on = end < row_end[at]
        first[end[on]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    seen = kind[starts] != 1
    return low, starts[seen], ends[seen], plain


class Encoder:
    """Token ids of texts by a ``tokenizers`` file, as little-endian bytes.

    Where the tokenizer drops white space and splits by ``_SPLIT``, a text's ids are those of its splits in order:
    plain texts are split by numpy, and each distinct split (by its 64-bit hash) is encoded once.  Other texts are cut at
    blanks and newlines, and other tokenizers encode whole texts.
    """

    #: splits kept: bounds the memory of a task
    MOST = 500_000

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        norm, split = head.get("normalizer") or {}, head.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in norm.get("normalizers", [])], [x.get("type") for x in split.get("pretokenizers", [])]
        self.by_word = (
            steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
            and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and split["pretokenizers"][0] | {"type": 0} == {"type": 0, "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
            and not split["pretokenizers"][1]["add_prefix_space"]
            and all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        )
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark = special[-1] if special else None
        self.width = 2 if max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.first, self.ids = np.zeros(0, U64), np.zeros(1, np.int64), np.zeros(0, self.kind)
        self.seat = np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces.  They are encoded as one text, between special tokens that none of them holds."""
        if self.mark is None or any(self.mark[0][:2] in p for p in pieces):
            return self._encode(pieces)
        text, mark = self.mark
        ids = np.array(self.tokenizer.encode(text.join(pieces), add_special_tokens=False).ids, self.kind)
        cuts = np.flatnonzero(ids == mark)
        return [ids[a:b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])]

    def _learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Where each split's ids are; new splits are encoded."""
        names, at, where = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, names)
        there = spot < len(self.hashes)
        there[there] = self.hashes[spot[there]] == names[there]
        if not there.all():
            if len(self.hashes) > self.MOST:
                self._forget()
                there[:] = False
            new = np.flatnonzero(~there)
            texts = [bytes(low[starts[k] : ends[k]]).decode() for k in at[new]]
            got: list[np.ndarray] = []
            for i in range(0, len(texts), 2000):
                got += self._pieces(texts[i : i + 2000])
            self.first = np.append(self.first, self.first[-1] + np.cumsum([len(g) for g in got]))
            self.ids = np.concatenate([self.ids, *got]).astype(self.kind)
            every = np.concatenate([self.hashes, names[new]])
            order = np.argsort(every, kind="stable")
            self.hashes, self.seat = every[order], np.concatenate([self.seat, len(self.seat) + np.arange(len(new))])[order]
            spot = np.searchsorted(self.hashes, names)
        return self.seat[spot][where]

    def batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with the end id after each, number of ids of each row)."""
        n = len(offsets) - 1
        slow: dict[int, np.ndarray] = {}
        if self.by_word:
            low, starts, ends, plain = _plain(raw, offsets)
            seat = self._learn(low, starts, ends, span_hashes(low, starts, ends)) if len(starts) else np.zeros(0, np.int64)
            rows = np.searchsorted(starts, offsets)
        else:
            plain, seat, rows = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        size = self.first[seat + 1] - self.first[seat]
        count = np.diff(np.concatenate([[0], np.cumsum(size)])[rows])
        others = np.flatnonzero(~plain)
        texts = [bytes(raw[offsets[i] : offsets[i + 1]]).decode() for i in others]
        if self.by_word:
            for i, text in zip(others, texts):
                pieces = _PIECE.findall(text)
                own = [x for k in range(0, len(pieces), 2000) for x in self._pieces(pieces[k : k + 2000])]
                slow[i] = np.concatenate(own) if own else np.zeros(0, self.kind)
        elif texts:
            slow = dict(zip(others, self._encode(texts)))
        for i, x in slow.items():
            count[i] = len(x)
        ends = np.cumsum(count + 1)
        out = np.empty(int(ends[-1]) if n else 0, self.kind)
        out[ends - 1] = self.end_id
        hole = np.ones(len(out), bool)
        hole[ends - 1] = False
        for i, x in slow.items():
            out[ends[i] - 1 - len(x) : ends[i] - 1] = x
            hole[ends[i] - 1 - len(x) : ends[i] - 1] = False
        total = int(size.sum())
        flat = np.repeat(self.first[seat] - (np.cumsum(size) - size), size) + np.arange(total)
        out[hole] = self.ids[flat]
        return out, count + 1

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, count = self.batch(*buffers(pa.array(texts, pa.string())))
        return np.split(ids, np.cumsum(count)[:-1]) if texts else []


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a worker: its splits stay known from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = None, None
        counts: list[np.ndarray] = []
        doc_ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        uri = f"{folder}/{uuid.uuid4().hex}.tok"
        for batch in batches:
            if encode is None:
                encode = encoder(tokenizer, end_id)
                fs, path = filesystem(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            ids, texts = batch.columns
            nulls.append(np.asarray(ids.is_null()))
            doc_ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            raw, offsets = buffers(texts)
            for i, j in slices(offsets, 2 << 20):
                a, b = int(offsets[i]), int(offsets[j])
                x, n = encode.batch(raw[a:b], offsets[i : j + 1] - a)
                out.write(x)
                counts.append(n)
        if out is None:
            return
        ends = EliasFano.encode(np.cumsum(np.concatenate(counts)))
        n, n_docs, missing = int(sum(c.sum() for c in counts)), sum(map(len, counts)), int(np.concatenate(nulls).sum())
        there = np.concatenate(doc_ids)[missing:]
        least = int(there[0]) if len(there) else 0
        with np.errstate(over="ignore"):
            names = EliasFano.encode(there.view(np.uint64) - np.array(least, np.int64).astype(np.uint64))
        for x in (*ends.parts(), *names.parts()):
            out.write(x.tobytes())
        out.write(struct.pack(_HEAD, MAGIC, encode.width, n_docs, n, missing, least, *(x for e in (ends, names) for x in (e.low_bits, len(e.high), len(e.samples)))))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n_docs]), pa.array([n])], names=["uri", "n_docs", "n_ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files; returns their manifest in order: part, uri, n_docs, n_ids, base (ids of all files before)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    ordered = df.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text")
    folder = new_dir(spark, "tokens")
    made = ordered.select("id", "text").mapInArrow(lean(_writer(folder, tokenizer, end_id)), "uri string, n_docs long, n_ids long")
    made = made.withColumn("part", F.spark_partition_id())
    made.write.parquet(f"{folder}/manifest")
    # a row per file: a running sum over them is one small task, and nothing comes to the driver
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(made.schema).parquet(f"{folder}/manifest")
    return manifest.select(F.col("part").cast("long"), "uri", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")).alias("base"))


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, at = TokenFile(uri), 0
                for i in range(0, t.n_docs, RANGE):
                    j = min(i + RANGE, t.n_docs)
                    ends = t.ends.select_range(i, j).astype(np.int64)
                    starts = np.concatenate([[at], ends[:-1]])
                    crc: list[int] = []
                    while len(crc) < j - i:  # long documents are read one by one
                        a = len(crc)
                        b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 22), "right")))
                        ids = t.ids(int(starts[a]), int(ends[b - 1])).astype("<u4")
                        crc += [zlib.crc32(ids[x:y]) for x, y in zip(starts[a:b] - starts[a], ends[a:b] - starts[a])]
                    yield pa.RecordBatch.from_arrays([t.doc_ids(i, j), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])
                    at = int(ends[-1])

    spark: SparkSession = manifest.sparkSession
    total = manifest.agg(F.sum("n_ids")).first()[0] or 0
    one_each = manifest.select("uri", "base").repartition(max(spark.sparkContext.defaultParallelism, -(-total // TASK_IDS)), "uri")
    return one_each.mapInArrow(lean(run), "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
