"""URL rules in a sorted array of 64-bit digests.

Rules are strings "host/path" with the verdict allow or block. Their xxhash64 digests are written as one sorted
array beside the full strings; the file goes to the executors with SparkContext.addFile and is memory-mapped by
each worker. A url is probed with every suffix of its host at a dot and every path prefix whose length some rule of
the file has, by vectorised binary search; a hit counts only if the stored string equals the probe, so digests that
collide do no harm. The longest rule wins, of two that are equally long the one with the longer host.

Edge cases: a null url or one without "://" has an empty host and path, and no rule fits it; very long urls are read
whole, but only path prefixes as long as some rule's are probed; repeated rules must agree, and repeated pages are
judged alike and stay; of rules of equal length the one with the longer host wins; no rules at all give the default
verdict; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_MAPS: dict[str, "Rules"] = {}


def write_rules(rules: Iterable[tuple[str, str]], path: str) -> None:
    """File: number of rules, path lengths and their number; sorted digests; string offsets; verdicts; strings (UTF-8)."""
    given: dict[str, str] = {}
    for rule, verdict in rules:
        host, slash, _ = rule.partition("/")
        if not slash or verdict not in ("allow", "block") or given.setdefault(host.lower() + rule[len(host) :], verdict) != verdict:
            raise ValueError(f"bad or contradictory rule: {rule} {verdict}")
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v == "block") for r, v in given.items())
    lengths = sorted({len(r.partition("/")[2]) + 1 for r in given})
    offsets = np.cumsum([0, *(len(r[1]) for r in rows)])
    with open(path, "wb") as f:
        f.write(np.array([len(rows), len(lengths), *lengths], "<i8").tobytes())
        f.write(np.array([r[0] for r in rows], "<u8").tobytes())
        f.write(offsets.astype("<i8").tobytes())
        f.write(np.array([r[2] for r in rows], "<u1").tobytes())
        f.write(b"".join(r[1] for r in rows))


class Rules:
    """A memory-mapped file of rules."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, k = np.frombuffer(self.map, "<i8", 2)
        at = 16
        self.lengths = np.frombuffer(self.map, "<i8", k, at).tolist()
        at += 8 * int(k)
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        at += 8 * int(n)
        self.offsets = np.frombuffer(self.map, "<i8", n + 1, at)
        at += 8 * int(n + 1)
        self.blocks = np.frombuffer(self.map, "<u1", n, at)
        self.strings = at + int(n)

    def string(self, i: int) -> bytes:
        return self.map[self.strings + int(self.offsets[i]) : self.strings + int(self.offsets[i + 1])]

    def match(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The rule and its verdict for each url; None where none fits."""
        probes: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            labels = host.split(".")
            heads = [path[:k] for k in self.lengths if k <= len(path)]
            for k in range(len(labels)):
                tail = ".".join(labels[k:])
                probes += [(tail + h).encode() for h in heads]
                owner += [i] * len(heads)
        rule: list[str | None] = [None] * len(hosts)
        verdict: list[str | None] = [None] * len(hosts)
        if not probes or not len(self.keys):
            return rule, verdict
        digest = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digest)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digest)
        best: dict[int, tuple[int, int]] = {}
        for p in hits.tolist():
            k = int(at[p])
            while k < len(self.keys) and self.keys[k] == digest[p]:  # equal digests stand side by side
                if self.string(k) == probes[p]:
                    text = probes[p].decode()
                    size = (len(text), text.index("/"))
                    if size > best.get(owner[p], (0, 0)):
                        best[owner[p]] = size
                        rule[owner[p]], verdict[owner[p]] = text, "block" if self.blocks[k] else "allow"
                k += 1
        return rule, verdict


def _judge(name: str, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if name not in _MAPS:
                _MAPS[name] = Rules(SparkFiles.get(name))
            rule, verdict = _MAPS[name].match(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            columns = [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    return run


def host_and_path(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path). A-Z of the host become lower case; other letters stay."""
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = pages.select(F.col(id_col).alias("page_id"), rest.alias("rest"))
    return parts.select("page_id", F.translate(host, upper, lower).alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for every row of pages."""
    spark = pages.sparkSession
    common.ship(spark)
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="seqlume-rules-"), name)
    write_rules(rules, path)
    spark.sparkContext.addFile(path)
    parts = host_and_path(pages, id_col, url_col)
    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(_judge(name, default), f"page_id {kind}, host string, path string, rule string, verdict string")
