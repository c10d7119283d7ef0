"""URL rules in a sorted array of 64-bit digests, memory-mapped and probed by binary search.

A rule is a host and a path prefix, written as one string (``example.com/en/``). Three files hold
a rule set: the sorted xxhash64 digests of the rules, the places of the rules' strings, and the
strings. They go to the executors through Spark's file distribution, and each Python worker maps
them, so that a rule set costs a machine its size once, whatever the number of tasks. A digest
that is found counts only if the stored string equals the candidate.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of an url; both empty for null or without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class DigestRules:
    """A rule set: (verdict, rule) pairs; of equal rules the last holds."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        verdicts = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            verdicts[f"{host.translate(_UPPER)}/{path}".encode()] = verdict == "block"
        keys = sorted(verdicts, key=lambda k: (xxhash.xxh64_intdigest(k), k))
        self.digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        self.ends = np.cumsum([0, *map(len, keys)]).astype(np.int64)
        self.blocks = np.array([verdicts[k] for k in keys], dtype=np.uint8)
        self.strings = np.frombuffer(b"".join(keys), dtype=np.uint8)
        self.path_lengths = sorted({len(k.partition(b"/")[2]) + 1 for k in keys}, reverse=True)
        self.most_labels = max((k.partition(b"/")[0].count(b".") + 1 for k in keys), default=0)

    def publish(self, spark: SparkSession) -> dict:
        """Write the arrays and hand them to every executor; returns what ``opened`` takes."""
        name, folder = uuid.uuid4().hex, tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the files from here
        files = {}
        for part in ("digests", "ends", "blocks", "strings"):
            path = os.path.join(folder, f"rules-{name}.{part}")
            array = getattr(self, part)
            (array if len(array) else np.zeros(1, array.dtype)).tofile(path)
            spark.sparkContext.addFile(path)
            files[part] = (os.path.basename(path), array.dtype.str, len(array))
        return {"files": files, "path_lengths": self.path_lengths, "most_labels": self.most_labels}


class MappedRules:
    """The rule set as a Python worker sees it."""

    def __init__(self, published: dict) -> None:
        for part, (name, dtype, n) in published["files"].items():
            setattr(self, part, np.memmap(SparkFiles.get(name), dtype=dtype, mode="r")[:n])
        self.path_lengths, self.most_labels = published["path_lengths"], published["most_labels"]

    def candidates(self, host: str, path: str) -> list[bytes]:
        """The strings of all rules that could fit, longest first."""
        labels = host.split(".")
        labels = labels[-self.most_labels :] if self.most_labels else []
        hosts = [".".join(labels[k:]) for k in range(len(labels))]
        raw = path.encode()
        found = [h.encode() + raw[:n] for h in hosts for n in self.path_lengths if raw[:1] == b"/" and n <= len(raw)]
        return sorted(found, key=len, reverse=True)

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Place of each probe among the rules, -1 without one."""
        out = np.full(len(probes), -1, np.int64)
        if not probes or not len(self.digests):
            return out
        digests = np.array([xxhash.xxh64_intdigest(p) for p in probes], dtype=np.uint64)
        at = np.searchsorted(self.digests, digests)
        hit = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests))
        for i in hit:
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == digests[i]:
                if self.string(k) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def string(self, k: int) -> bytes:
        return self.strings[self.ends[k] : self.ends[k + 1]].tobytes()


_SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's path; of the rules
    that fit, the longest string decides. Without one, rule is null and the verdict ``default``.
    Null urls, and urls without ``://``, have an empty host and path and so no rule; an empty path
    doesn't start with ``/``. A null page_id stays null, repeated rows give repeated results, an
    empty table an empty one, and other columns are not read.
    """
    published = DigestRules(rules).publish(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = MappedRules(published)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            probes, owner = [], []
            for i, (host, path) in enumerate(parts):
                own = mapped.candidates(host, path)
                probes += own
                owner += [i] * len(own)
            best: dict[int, int] = {}
            for i, k in zip(owner, mapped.find(probes), strict=True):
                if k >= 0:
                    best.setdefault(i, int(k))
            rule = [mapped.string(best[i]).decode() if i in best else None for i in range(len(parts))]
            verdict = [("block" if mapped.blocks[best[i]] else "allow") if i in best else default for i in range(len(parts))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=_SCHEMA)

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
