"""URL filtering by a sorted array of 64-bit digests, memory-mapped, probed by binary search.

A rule is a host and a path prefix with a verdict. Its key is the xxhash of host and path; the keys lie sorted
in a file beside the rules' full strings, which Spark ships to each executor once (`addFile`) and workers map
into memory. A URL probes every suffix of its host with every rule length that its path has, all URLs of a batch
in one vectorised search; a digest that matches is confirmed against the stored string. The longest rule wins.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = ("allow", "block")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty if there is none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{path}")


def write_rules(rules: list[tuple[str, str, str]], file: str) -> None:
    """rules: (verdict, host, path), hosts taken with A-Z in lower case as a url's. Of rules with one host and path the last holds."""
    known = {(h.translate(_LOWER), p): v for v, h, p in rules}
    if bad := set(known.values()) - set(VERDICTS):
        raise ValueError(f"verdicts are allow and block, not {sorted(bad)}")
    entries = sorted((_digest(h, p), h, p, v) for (h, p), v in known.items())
    strings = [f"{h}\0{p}".encode() for _, h, p, _ in entries]
    lengths = sorted({len(p) for _, _, p, _ in entries})
    with open(file, "wb") as f:
        f.write(struct.pack("<qq", len(entries), len(lengths)))
        f.write(np.array(lengths, "<i8").tobytes())
        f.write(np.array([e[0] for e in entries], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, strings)]).astype("<i8").tobytes())
        f.write(np.array([VERDICTS.index(e[3]) for e in entries], "u1").tobytes())
        f.write(b"".join(strings))


class RuleFile:
    """A mapped file of write_rules."""

    def __init__(self, file: str):
        data = np.memmap(file, np.uint8, "r")
        n, m = struct.unpack("<qq", data[:16].tobytes())
        at = 16
        parts = []
        for size, kind in ((m, "<i8"), (n, "<u8"), (n + 1, "<i8"), (n, "u1")):
            width = np.dtype(kind).itemsize * size
            parts.append(data[at : at + width].view(kind))
            at += width
        (self.lengths, self.keys, self.ends, self.verdicts), self.strings = parts, data[at:]

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest fitting rule of each URL, as host and path in one string, and its verdict."""
        probes: list[int] = []
        told: list[tuple[int, str, str]] = []
        lengths = self.lengths.tolist()
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            heads = [path[:n] for n in lengths if n <= len(path)]
            at = 0
            while heads:
                suffix = host[at:]
                for head in heads:
                    probes.append(_digest(suffix, head))
                    told.append((k, suffix, head))
                if (dot := host.find(".", at)) < 0:
                    break
                at = dot + 1
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        if not probes or not len(self.keys):
            return rules, verdicts
        best: dict[int, tuple[int, int]] = {}
        keys = np.array(probes, np.uint64)
        first, past = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for p in np.flatnonzero(past > first).tolist():
            k, suffix, head = told[p]
            want = f"{suffix}\0{head}".encode()
            for i in range(first[p], past[p]):  # more than one only if digests collide
                if self.strings[self.ends[i] : self.ends[i + 1]].tobytes() == want:
                    rule = suffix + head
                    if (size := (len(rule), len(suffix))) > best.get(k, (-1, -1)):
                        rules[k], verdicts[k], best[k] = rule, VERDICTS[self.verdicts[i]], size
        return rules, verdicts


@lru_cache(maxsize=4)
def _mapped(file: str) -> RuleFile:
    return RuleFile(file)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of each row's url.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest rule (host and path
    together; of equals that with the longer host) wins; without one the verdict is `otherwise`. A null url, or one
    without `://`, has an empty host and path. Rows with null or repeated ids come out as they are. Other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    name = f"rules-{uuid.uuid4().hex}.bin"
    local = str(Path(tempfile.mkdtemp(prefix="tidemark-")) / name)
    write_rules(rules, local)
    spark.sparkContext.addFile(local)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _mapped(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rule, verdict = file.judge(part.column("host").to_pylist(), part.column("path").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rule, pa.string()), pa.array([v or otherwise for v in verdict], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    narrow = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    kind = dict(narrow.dtypes)["page_id"]
    return narrow.mapInArrow(rows, f"page_id {kind}, host string, path string, rule string, verdict string")
