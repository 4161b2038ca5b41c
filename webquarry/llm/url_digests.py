"""URL filtering with a sorted digest array.

Rules and listed hosts or URLs are keys (host + path). Their 64-bit xxhash digests are one
sorted array with the offsets of the full keys behind it, written once to the shared
checkpoint folder and handed to every executor by Spark as a file. Tasks memory-map it, so the
Python workers of a machine share its pages; a batch of URLs is probed by vectorised binary
search, and each hit is confirmed against the stored key, so that digest collisions decide
nothing.

A key fits its host and all subdomains if the URL's path starts with the key's path. A URL is
probed with each of its host's suffixes joined with each prefix of its path that is as long as
some key's path. The longest rule wins; where no rule fits, a listed key blocks.

A file holds at most about ``most`` bytes; a longer list is cut into several files by digest
range, each with all digests of its range, and a URL is probed against each in turn. A long list
is a DataFrame: tasks sort and pack its ranges, and the driver passes one after the other on.

Defined results: a null URL or one without ``://`` has an empty host and path, fits nothing and
is allowed; empty hosts fit nothing; of rules of equal length that of the longer host wins, and
of two rules with one key the blocking one; repeated rows are judged each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm.shared import cut, hand_out

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hosts that are blocked unless a rule says otherwise; with them all their subdomains.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))
FILE_BYTES = 256 << 20
#: Probes that are looked up together, about.
PROBES = 1 << 16
#: Hosts are the same whatever the case of these letters, and no others.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_KINDS = ("allow", "block", "listed")


def digest_array(keys: list[tuple[str, str, str]]) -> bytes:
    """Keys (host, path, kind) as one buffer: counts, sorted digests, offsets, path starts, kinds, bytes of the keys."""
    rows = sorted({(xxhash.xxh64_intdigest((h + p).encode()), (h + p).encode(), len(h.encode()), _KINDS.index(k)) for h, p, k in keys})
    digests = np.array([r[0] for r in rows], np.uint64)
    offsets = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.uint64)
    hosts = np.array([r[2] for r in rows], np.uint64)
    kinds = np.array([r[3] for r in rows], np.uint64)
    return b"".join([np.array([len(rows)], np.uint64).tobytes(), digests.tobytes(), offsets.tobytes(), hosts.tobytes(), kinds.tobytes(), *(r[1] for r in rows)])


class DigestArray:
    """A memory-mapped digest array."""

    def __init__(self, data: np.ndarray) -> None:
        n = int(data[:8].view(np.uint64)[0])
        at = 8 + 8 * np.cumsum([0, n, n + 1, n, n])
        self.digests, self.offsets, self.hosts, self.kinds = (data[a:b].view(np.uint64) for a, b in zip(at[:-1], at[1:], strict=True))
        self.keys = data[at[-1] :]
        lengths = self.offsets[1:] - self.offsets[:-1] - self.hosts
        #: The lengths in bytes that keys have: of hosts, and of the paths behind hosts of each length.
        self.lengths: dict[int, list[int]] = {}
        for h, p in np.unique(np.stack([self.hosts, lengths], axis=1), axis=0).astype(int).tolist():
            self.lengths.setdefault(h, []).append(p)

    def key(self, i: int) -> bytes:
        """The full key at i."""
        return self.keys[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def find(self, probes: list[bytes]) -> list[list[int]]:
        """The places of each probe in the array, confirmed by the stored keys."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        low, high = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        out: list[list[int]] = [[] for _ in probes]
        for i in np.flatnonzero(low < high).tolist():
            out[i] = [j for j in range(int(low[i]), int(high[i])) if self.key(j) == probes[i]]
        return out


@lru_cache(maxsize=8)
def open_array(name: str) -> DigestArray:
    """The digest array of a file that Spark has brought to this machine."""
    return DigestArray(np.memmap(SparkFiles.get(name), np.uint8, "r"))


def share(spark: SparkSession, keys: list[tuple[str, str, str]], most: int = FILE_BYTES) -> list[str]:
    """Writes the keys as files of at most about ``most`` bytes and hands them to all executors; their names."""
    size = sum(len(h) + len(p) + 40 for h, p, _ in keys)
    parts = max(1, -(-size // most))
    groups: list[list[tuple[str, str, str]]] = [[] for _ in range(parts)]
    for h, p, k in keys:
        groups[xxhash.xxh64_intdigest((h + p).encode()) * parts >> 64].append((h, p, k))
    return [hand_out(spark, digest_array(group), "digests") for group in groups]


def share_list(listed: DataFrame, most: int = FILE_BYTES) -> list[str]:
    """Hands out a DataFrame of listed hosts or URLs (host, path) as digest arrays, packed by tasks; their names."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(c).to_pylist() for c in ("host", "path"))
            top = [xxhash.xxh64_intdigest((h + p).encode()) >> 33 for h, p in zip(hosts, paths, strict=True)]
            yield pa.record_batch({"host": batch.column("host"), "path": batch.column("path"), "top": pa.array(top, pa.int64())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[str, str, str]]] = {}
        for batch in batches:
            for part, h, p in zip(*(batch.column(c).to_pylist() for c in ("part", "host", "path")), strict=True):
                kept.setdefault(part, []).append((h, p, "listed"))
        for part, keys in kept.items():
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "data": pa.array([digest_array(keys)], pa.binary())})

    keys = listed.select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> ''").distinct()
    keys = cut(keys.mapInArrow(digested, "host string, path string, top long"))
    size = keys.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 40), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // most))
    ranges = keys.withColumn("part", F.floor(F.col("top") / ((1 << 31) / parts)).cast("long"))
    packed = cut(ranges.repartition(parts, "part").select("part", "host", "path").mapInArrow(pack, "part long, data binary"))
    return [hand_out(listed.sparkSession, bytes(row["data"]), "digests") for row in packed.toLocalIterator()]


def _probes(host: bytes, path: bytes, lengths: dict[int, list[int]]) -> Iterator[bytes]:
    """What could be a key of these lengths: ends of the host at its dots with starts of the path. Long hosts have no more than short ones."""
    for h, paths in lengths.items():
        if h == len(host) or (h < len(host) and host[-h - 1] == 0x2E):
            for p in paths:
                if p <= len(path):
                    yield host[-h:] + path[:p]


def _low(host: str) -> str:
    """A-Z in lower case, nothing else."""
    return host.encode().lower().decode()


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: list[str] | DataFrame, most: int = FILE_BYTES) -> DataFrame:
    """Every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``blocked``: some hosts, or a DataFrame of hosts and URLs (host, path).
    """
    keys = [(_low(h), p, kind) for h, p, kind in rules]
    if isinstance(blocked, DataFrame):
        names = share(pages.sparkSession, keys, most) + share_list(blocked, most)
    else:
        names = share(pages.sparkSession, keys + [(_low(h), "", "listed") for h in blocked], most)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            best: list[tuple[tuple[int, int, bool], bytes, str] | None] = [None] * len(hosts)
            listed = [False] * len(hosts)

            def decide(array: DigestArray, row: list[int], probes: list[bytes]) -> None:
                for i, found in zip(row, array.find(probes), strict=True):
                    for j in found:
                        kind, key = _KINDS[int(array.kinds[j])], array.key(j)
                        if kind == "listed":
                            listed[i] = True
                        else:
                            rank = (len(key), int(array.hosts[j]), kind == "block")
                            if best[i] is None or rank > best[i][0]:
                                best[i] = (rank, key, kind)

            for name in names:
                array = open_array(name)
                row, probes = [], []
                for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                    own = list(_probes(host.encode(), path.encode(), array.lengths)) if host else []
                    row += [i] * len(own)
                    probes += own
                    if len(probes) >= PROBES:
                        decide(array, row, probes)
                        row, probes = [], []
                decide(array, row, probes)
            rule = [b and b[1].decode() for b in best]
            verdict = [b[2] if b else "block" if bad else "allow" for b, bad in zip(best, listed, strict=True)]
            yield pa.record_batch({"page_id": batch.column("page_id"), "host": batch.column("host"), "path": batch.column("path"), "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())})

    rest = F.expr("IF(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    after = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    split = pages.select(F.col("page_id").cast("long"), after.alias("rest")).select("page_id", host.alias("host"), path.alias("path"))
    return split.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def op9_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rule that fits its url and the verdict."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), list(RULES), list(BLOCKED_HOSTS))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rh, rp, kind) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(kind, length(rh || rp)) AS kind
  FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(kind, CASE WHEN regexp_matches(host, '^(.*\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id
"""

QUERIES = {"op9_url_digests": op9_url_digests}
ORACLES = {"op9_url_digests": ORACLE}
