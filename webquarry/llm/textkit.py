"""Word and n-gram hashing of Arrow string columns with numpy, shared by several operators.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return. All hashes are deterministic 64-bit values that depend on the word's
bytes only, so tasks on different machines agree on them.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 19
#: Bytes of rows that a worker is sent at once. Spark's own limit is a number of rows, however long their texts
#: are; executor and worker each hold such a batch, the executor in buffers of up to twice its size.
BATCH_BYTES = "4m"

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the machine at its end, as its worker process stays for other tasks."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def mapped(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows.mapInArrow`` of a ``lean`` function, in batches of BATCH_BYTES if the session doesn't say how large."""
    conf, most = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(most, None) is None:
        conf.set(most, BATCH_BYTES)
    return rows.mapInArrow(lean(work), schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = {_BASE: _powers(_BASE, CHUNK_BYTES), _BASE_INV: _powers(_BASE_INV, CHUNK_BYTES)}


def _power(base: int, n: int) -> np.ndarray:
    known = _POWERS[base]
    return known[:n] if n <= len(known) else _powers(base, n)


@dataclass
class Words:
    """The words of some texts, in order: byte range, text number, hash; and per text its range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @functools.cached_property
    def odd_gaps(self) -> np.ndarray:
        """For each word, how many gaps before it aren't just one space."""
        plain = (self.start[1:] - self.end[:-1] == 1) & (self.data[self.end[:-1]] == 0x20)
        return np.concatenate([[0], np.cumsum(~plain)])

    def text(self, i: int, j: int) -> str:
        """Words i .. j-1, joined by one space."""
        data = self.data
        if i < j and self.odd_gaps[i] == self.odd_gaps[j - 1]:
            return data[self.start[i] : self.end[j - 1]].tobytes().decode("utf-8")
        return b" ".join(data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True)).decode("utf-8")


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    if not len(texts):
        return
    _, at = _buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


def words(texts: pa.Array) -> Words:
    """The words of every text, with hashes."""
    data, at = _buffers(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        zero = np.zeros(len(texts), np.int64)
        return Words(data, none, none, none, np.zeros(0, np.uint64), zero, zero)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[1:-1]
    edge = edge[edge < n]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    rolled = np.empty(n + 1, np.uint64)
    rolled[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=rolled[1:])
    value = (rolled[end] - rolled[start]) * _power(_BASE_INV, n + 1)[start]
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    return Words(data, start, end, doc, mix(value + (end - start).astype(np.uint64)), first, count)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside one text, and the index of its first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    total = hashes[:m].copy()
    for j in range(1, n):
        total *= _STEP
        total += hashes[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(total[at]), at


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return x.view(np.int64)
