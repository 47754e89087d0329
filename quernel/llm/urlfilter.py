"""URL filters: a sorted digest array of rules, probed by vectorised binary search.

A rule blocks or allows a host with all its subdomains, below a path prefix.  Its key is the 64-bit xxhash of
``host + path``.  The keys are one sorted array in a file of the shared folder; tasks memory-map it where that is mounted, so its
pages are shared by a host's workers and no table is broadcast (where the folder is an object store, each worker reads the file into its own memory).  A URL's candidates are its
host suffixes times the path lengths that rules have, longest first; each probe that finds a key is confirmed by
comparing the full stored string, so a collision can't decide.

The method's own verdict, where no rule fits, is allow: the array holds what is known, and the rest passes.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; a URL without a path
(``http://a.com``) fits no rule whose path is ``/...``; of rules that repeat a host and path, block wins.
"""

from __future__ import annotations

import mmap
import os
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from .shared import filesystem, new_dir, write_bytes

_HEAD = struct.Struct("<8sqqq")
_MAGIC = b"QDIGEST1"


def write_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Write (verdict, host, path) rules as a digest array in the shared folder; returns its URI."""
    best: dict[bytes, tuple[str, int]] = {}
    for verdict, host, path in rules:
        key = (host + path).encode()
        block = int(verdict == "block")
        best[key] = (host, max(block, best[key][1] if key in best else 0))
    keys = sorted(best, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
    at = np.cumsum([0, *map(len, keys)]).astype(np.int64)
    verdicts = np.array([best[k][1] for k in keys], np.uint8)
    lengths = np.array(sorted({len(k.decode()) - len(best[k][0]) for k in keys}), np.int64)
    data = _HEAD.pack(_MAGIC, len(keys), len(lengths), int(at[-1])) + digests.tobytes() + at.tobytes() + lengths.tobytes() + verdicts.tobytes() + b"".join(keys)
    uri = new_dir(spark, "rules") + "/rules.bin"
    write_bytes(uri, data)
    return uri


class Rules:
    """A digest array, memory-mapped."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        if os.path.exists(path):
            with open(path, "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:  # a remote shared folder can't be mapped: each worker holds the bytes
            with fs.open_input_file(path) as f:
                data = f.read()
        magic, n, m, size = _HEAD.unpack_from(data, 0)
        assert magic == _MAGIC, "not a rule file"
        at = _HEAD.size
        self.digests = np.frombuffer(data, np.uint64, n, at)
        self.at = np.frombuffer(data, np.int64, n + 1, at + 8 * n)
        at += 8 * n + 8 * (n + 1)
        self.lengths = np.frombuffer(data, np.int64, m, at)[::-1].tolist()
        self.longest = int(np.diff(self.at).max()) if n else 0  # in bytes: no key has more code points
        self.blocks = np.frombuffer(data, np.uint8, n, at + 8 * m)
        self.data, self.start = data, at + 8 * m + n

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The rule of each key, -1 if there is none."""
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        lo, hi = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        out = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(hi > lo):
            for r in range(lo[i], hi[i]):
                if self.data[self.start + self.at[r] : self.start + self.at[r + 1]] == keys[i]:
                    out[i] = r
        return out

    def text(self, r: int) -> str:
        return bytes(self.data[self.start + self.at[r] : self.start + self.at[r + 1]]).decode()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The longest rule that fits each URL, and its verdict."""
        memo: dict[str, int] = {}
        spots: list[list[int]] = []
        for host, path in zip(hosts, paths):
            own = []
            if host:
                # suffixes longer than the longest rule can't fit
                least = max(0, len(host) - self.longest)
                dots = [i + 1 for i in range(max(0, least - 1), len(host)) if host[i] == "."]
                for d in [0, *dots] if not least else dots:
                    suffix = host[d:]
                    if suffix:
                        own += [memo.setdefault(suffix + path[:n], len(memo)) for n in self.lengths if n <= len(path)]
            spots.append(own)
        found = self.find([k.encode() for k in memo])
        names = list(memo)
        rules: list[str | None] = []
        verdicts = []
        for own in spots:
            # of one length, candidates of different host suffixes never both fit: a longer host has a longer key
            fits = [k for k in own if found[k] >= 0]
            best = max(fits, key=lambda k: len(names[k]), default=None)
            rules.append(None if best is None else names[best])
            verdicts.append("block" if best is not None and self.blocks[found[best]] else "allow")
        return rules, verdicts


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each page."""
    uri = write_rules(pages.sparkSession, rules)
    made: dict[str, Rules] = {}

    @arrow_udf("struct<rule: string, verdict: string>")
    def judge(host: pa.Array, path: pa.Array) -> pa.Array:
        if uri not in made:
            made[uri] = Rules(uri)
        rule, verdict = made[uri].judge(host.to_pylist(), path.to_pylist())
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["rule", "verdict"])

    url = F.col(url_col).cast("string")
    df = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    return df.withColumn("j", judge("host", "path")).select(id_col, "host", "path", "j.rule", "j.verdict")
