"""WARC archives of pages, a globally ordered capture index by external merging, and reading through that index.

Writing: every page becomes a response record, or a revisit of the record whose payload is equal and whose id is the
largest; each record is a gzip member of its own.  Which pages are responses is decided by a digest table, with
map-side combining, so a payload that a third of all pages share costs one row a task.  Each writing task also leaves a
run of its captures, sorted by URL key, timestamp and id, next to its archive.

Index: a merging task takes one key range of at most ``FAN_IN`` runs, reads that range of each by the run's own sparse index, and
merges them with a loser tree.  Where there are more runs, passes before the last merge them in groups, range by range, into longer
runs of several pieces.  Ranges are cut at quantiles of the sparse keys (one short string for each ``RANGE_ROWS`` captures is all that the driver sees) and go down to timestamp and id, so a
URL that a third of all captures share is cut, too.  Ranges are globally ordered, so the rows of the last pass by part and seq are each URL's capture history.

Reading: records are found by the index alone, by file, offset and length, and what the index doesn't list isn't read.  Only its three narrow columns are
shuffled, by file; a task reads a file's spans in their order.  What a revisit's payload was is known from its headers.

Only archives named in the manifest (written by successful tasks) count.

Defined cases: a null payload is empty; null URLs are written as ``urn:page:<id>``; rows that repeat the largest id of a
payload are all responses; a null id never is the largest unless all are null, and then the record is a response; control characters of a URL
are percent-encoded in its key.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import filesystem, new_dir
from .textops import bounded_batches, lean

#: rows of a run between entries of its sparse index
STRIDE = 256
#: captures that one merging task takes, about; runs that it merges at most
RANGE_ROWS, FAN_IN = 500_000, 256
#: neighbouring records are read together, up to so many bytes
READ_BYTES = 4 << 20
#: archives that one reading task takes, about
TASK_BYTES = 64 << 20
#: hot payloads' rows are spread over so many join keys
SALTS = 16
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_CONTROL = re.compile(r"[\x00-\x1f]")
#: stands for a null id in captures: less than any
_NO_ID = -(1 << 63) - 1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Reversed host labels, then port, path and query, lower-cased: captures of a site sort together."""
    url = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    scheme, sep, rest = url.partition("://")
    if not sep:
        return url.lower()
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, _, port = rest[:cut].lower().rpartition("@")[2].partition(":")
    tail = rest[cut:].partition("#")[0].lower()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (f":{port}" if port else "") + (tail or "/")


def _stamp(page_id: int | None) -> str:
    """Tables without capture times get one from the id: deterministic, in 2024 or later."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, target: str | None, stamp: str) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {_clean(url) if url is not None else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_clean(target or '')}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _clean(url: str) -> str:
    return "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in url)


class LoserTree:
    """Merges sorted iterators; each step costs one comparison per level of the tree."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        n = self.n = len(runs)
        self.tree = [-1] * n
        for i in range(n):
            self._rise(i, True)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; an ended run goes last, ties go by run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _rise(self, winner: int, building: bool = False) -> None:
        at = (winner + self.n) // 2
        while at > 0:
            if building and self.tree[at] < 0:
                self.tree[at] = winner
                return
            if self._beats(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.n and (x := self.heads[w := self.tree[0]]) is not None:
            yield x
            self.heads[w] = next(self.runs[w], None)
            self._rise(w)


#: one capture: URL key, timestamp, page id (_NO_ID for null), URL, digest, type, file, offset, length
Capture = tuple[str, str, int, str, str, str, str, int, int]


def _key(c: Capture) -> str:
    """Sorts as the first three parts do: the tab is less than what a URL key or a timestamp holds."""
    return f"{c[0]}\t{c[1]}\t{c[2] - _NO_ID:020d}"


_RUN = "base string, n long, bytes long, run_bytes long, sparse array<string>, places array<long>, last string"


class _Run:
    """Writes a run: sorted captures as lines of JSON, with the key and place of every STRIDE-th."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.n, self.size, self.last = fs.open_output_stream(path), 0, 0, ""
        self.sparse: list[str] = []
        self.places: list[int] = []

    def add(self, c: Capture) -> None:
        if self.n % STRIDE == 0:
            self.sparse.append(_key(c))
            self.places.append(self.size)
        line = json.dumps(c, ensure_ascii=False).encode() + b"\n"
        self.file.write(line)
        self.n, self.size, self.last = self.n + 1, self.size + len(line), c

    def row(self, base: str, size: int) -> list[pa.Array]:
        self.file.close()
        values = [base, self.n, size, self.size, self.sparse, self.places, _key(self.last)]
        return [pa.array([v], k) for v, k in zip(values, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string()])]


_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = uuid.uuid4().hex, None
        captures: list[Capture] = []
        at = 0
        for batch in batches:
            if out is None:
                fs, path = filesystem(f"{folder}/{name}.warc.gz")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            ids, urls, payloads, refers, targets = (c.to_pylist() for c in batch.columns)
            for page_id, url, text, refers_to, target in zip(ids, urls, payloads, refers, targets):
                payload = (text or "").encode()
                digest, stamp = payload_digest(payload), _stamp(page_id)
                c = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = c.compress(record(page_id, url, payload, digest, refers_to, target, stamp)) + c.flush()
                out.write(data)
                shown = url if url is not None else f"urn:page:{page_id}"
                captures.append((url_key(shown), stamp, _NO_ID if page_id is None else page_id, shown, digest, "response" if refers_to is None else "revisit", f"{name}.warc.gz", at, len(data)))
                at += len(data)
        if out is None:
            return
        out.close()
        captures.sort()
        run = _Run(f"{folder}/{name}.run")
        for c in captures:
            run.add(c)
        yield pa.RecordBatch.from_arrays(run.row(f"{folder}/{name}", at), names=_RUN_NAMES)

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives and sorted runs; returns the manifest: base, n, bytes, run_bytes, sparse, places, last.

    Payloads of fewer than least_bytes are always responses.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    df = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("payload")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    groups = df.select("id", "url", "sha", F.octet_length("payload").alias("size")).where(F.col("size") >= least_bytes).groupBy("sha").agg(F.max_by("url", "id").alias("target"), F.max("id").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null")
    groups = groups.select(F.col("sha").alias("g_sha"), "target", "refers", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("g_salt"))
    salted = df.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    roles = salted.join(groups, (F.col("sha") == F.col("g_sha")) & (F.col("salt") == F.col("g_salt")), "left")
    revisit = F.col("refers").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers"))
    folder = new_dir(spark, "warc")
    rows = roles.select("id", "url", "payload", F.when(revisit, F.col("refers")).alias("refers"), F.when(revisit, F.col("target")).alias("target"))
    rows.mapInArrow(lean(_writer(folder)), _RUN).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _lines(base: str, start: int, end: int, low: str | None, high: str | None) -> Iterator[Capture]:
    """The captures of a run in [low, high), read from a part of its file."""
    fs, path = filesystem(f"{base}.run")
    with fs.open_input_file(path) as f:
        at, rest = start, b""
        while at < end:
            block = f.read_at(min(1 << 18, end - at), at)
            at += len(block)
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                c = tuple(json.loads(line))
                key = _key(c)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield c


def _cuts(runs: DataFrame, parts: int) -> list[str]:
    """Keys that cut all captures into about equal ranges: quantiles of equally spaced sparse entries, STRIDE times fewer than captures."""
    if parts < 2:
        return []
    keys = runs.select(F.explode("sparse").alias("k"))
    ranked = keys.repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    return sorted({r.k for r in ranked.collect()})[1:]


def _spans(cuts: list[str]):
    """Which part of each run's file holds each range that it reaches, by the run's own sparse index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for group, number, base, size, sparse, places, last in zip(*(c.to_pylist() for c in batch.columns)):
                for part in range(bisect.bisect_right(cuts, sparse[0]), bisect.bisect_right(cuts, last) + 1):
                    a = bisect.bisect_left(sparse, cuts[part - 1]) - 1 if part else 0
                    b = bisect.bisect_left(sparse, cuts[part]) if part < len(cuts) else len(places)
                    out.append((group, part, number, sparse[0], base, places[max(0, a)], places[b] if b < len(places) else size))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["group", "part", "run", "first", "base", "start", "end"])

    return run


def _merged(batches: Iterator[pa.RecordBatch], cuts: list[str]) -> Iterator[tuple[int, int, LoserTree]]:
    """(group, part, its captures in order); pieces of one run follow each other, so only one of them is open."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for (group, part), own in itertools.groupby(rows, key=lambda r: r[:2]):
        low, high = cuts[part - 1] if part else None, cuts[part] if part < len(cuts) else None
        pieces = [[r[4:] for r in run] for _, run in itertools.groupby(own, key=lambda r: r[2])]
        yield group, part, LoserTree([itertools.chain.from_iterable(_lines(*p, low, high) for p in run) for run in pieces])


def merge_index(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Merge the runs; returns a table in global order: part, seq, url_key, stamp, page_id, url, digest, record_type, file, offset, length."""
    total, n = manifest.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    numbers = manifest.select("base", (F.row_number().over(Window.orderBy("base")) - 1).cast("long").alias("run"))
    runs = manifest.join(numbers, "base")
    while True:
        groups = -(-n // FAN_IN) if n > FAN_IN else 1
        cuts = _cuts(runs, max(1, -(-total // (RANGE_ROWS * groups))))
        found = runs.select(F.expr(f"run div {FAN_IN if groups > 1 else max(n, 1)}").alias("group"), "run", "base", "run_bytes", "sparse", "places", "last")
        # a merging task gets a row per run, or piece of a run, in its range
        found = found.mapInArrow(lean(_spans(cuts)), "group long, part int, run long, first string, base string, start long, end long")
        found = found.repartition(groups * (len(cuts) + 1), "group", "part").sortWithinPartitions("group", "part", "run", "first")
        if groups == 1:
            return found.mapInArrow(lean(_index(cuts)), "part int, seq long, url_key string, stamp string, page_id long, url string, digest string, record_type string, file string, offset long, length long")
        folder = new_dir(spark, "runs")
        found.mapInArrow(lean(_longer(folder, cuts)), f"run long, {_RUN}").write.parquet(f"{folder}/manifest")
        runs, n = spark.read.parquet(f"{folder}/manifest"), groups


def _index(cuts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, captures in _merged(batches, cuts):
            seq = 0
            for own in itertools.batched(captures, 8192):
                yield _captures(part, seq, own)
                seq += len(own)

    return run


def _longer(folder: str, cuts: list[str]):
    """Writes each group's range as a piece of a longer run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, captures in _merged(batches, cuts):
            base, out = f"{folder}/{uuid.uuid4().hex}", None
            for c in captures:
                out = out or _Run(f"{base}.run")
                out.add(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), *out.row(base, 0)], names=["run", *_RUN_NAMES])

    return run


def _captures(part: int, seq: int, rows: tuple[Capture, ...]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    cols[2] = [None if x == _NO_ID else x for x in cols[2]]
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), *arrays], names=["part", "seq", "url_key", "stamp", "page_id", "url", "digest", "record_type", "file", "offset", "length"])


_RECORD = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string"


def _parsed(file: str, fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"{file}: record {fields['WARC-Record-ID']} is damaged")
    own = fields["WARC-Record-ID"][10:-1]
    return int(own) if own else None, int(http["Content-Length"]) if revisit else len(payload), digest, fields["WARC-Type"], int(fields["WARC-Refers-To"][10:-1]) if revisit else None, fields["WARC-Target-URI"]


def folder_of(manifest: DataFrame) -> str:
    """The folder of a manifest's archives, which the index names relative to it."""
    first = manifest.select("base").first()
    return first.base.rpartition("/")[0] if first else ""


def read_captures(index: DataFrame, folder: str, id_col: str = "page_id") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target of the records that an index lists by file, offset and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for name, own in itertools.groupby(rows, key=lambda r: r[0]):
            fs, path = filesystem(f"{folder}/{name}")
            with fs.open_input_file(path) as f:
                for some in itertools.batched(_records(f, ((at, size) for _, at, size in own)), 8192):
                    yield _read([_parsed(name, *r) for r in some])

    # an explicit number of tasks: Spark would size them by the index's rows, not by what they stand for
    spans = index.select("file", "offset", "length")
    parts = _tasks(spans, "length")
    return spans.repartition(parts, "file").sortWithinPartitions("file", "offset").mapInArrow(lean(run), _RECORD).withColumnRenamed("id", id_col)


def _tasks(rows: DataFrame, size: str) -> int:
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def _records(f, spans: Iterator[tuple[int, int]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records at ascending (offset, length); neighbours are read at once."""
    near: list[tuple[int, int]] = []
    for at, size in itertools.chain(spans, [(-1, 0)]):
        if near and (at != sum(near[-1]) or at + size - near[0][0] > READ_BYTES):
            begin = near[0][0]
            data = f.read_at(sum(near[-1]) - begin, begin)
            for a, n in near:
                yield _fields(zlib.decompress(data[a - begin : a - begin + n], 31))
            near = []
        near.append((at, size))


def _fields(whole: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_archives(manifest: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The same of every record of the archives, read from end to end without an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in batch.column(0).to_pylist():
                fs, path = filesystem(f"{base}.warc.gz")
                with fs.open_input_file(path) as f:
                    for some in itertools.batched(_stream(f), 8192):
                        yield _read([_parsed(base, *r) for r in some])

    return manifest.select("base").repartition(_tasks(manifest, "bytes"), "base").mapInArrow(lean(run), _RECORD).withColumnRenamed("id", id_col)


def _read(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"])


def _stream(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an open archive, a block of the file at a time."""
    d, raw, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = f.read(1 << 15)
            if not data:
                return
        raw.append(d.decompress(data))
        data = d.unused_data
        if d.eof:
            yield _fields(b"".join(raw))
            d, raw = zlib.decompressobj(31), []
