"""Periodic runs of words: every maximal stretch that repeats with a period.

A run's period comes from a Lyndon word: under one of the two orders of the words (one the
reverse of the other), the longest Lyndon word at some position of the run is as long as its
least period. So for each order the positions are scanned right to left with a stack of Lyndon
words, which gives the longest Lyndon word [i, j) at each position i; the run of that root is
what the period j - i can be extended to on both sides, and is one if it holds the root twice.
No suffix array is built.

Suffixes are compared, and roots extended, by longest common extensions: binary search over
differences of one rolling hash. A match that a comparison relies on is then compared word by
word, each stretch of one distance once; runs are compared word by word and as bytes, so that no
result depends on a hash: where one was wrong, the roots in question are extended by
comparing words alone, and the words of the chunk get numbers by their bytes.

Texts are scanned in chunks; marks that no word equals stand between them. A text of n words
takes about 120 n bytes and some n log n steps, in one task.

Defined results: a null text has no words and no runs; repeated rows each get a result; an
empty table gives an empty one; ids are carried as they are, null included; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import textkit

SHORTEST = 12
#: Words that are compared one by one before a hash is asked.
NEAR = 6
_MASK = 2**64 - 1
_BASE = 0x9E3779B97F4A7C15


class Extensions:
    """Common extensions of positions of ``ids``, the numbers of words, by hashes of their prefixes."""

    def __init__(self, ids: np.ndarray, base: int = _BASE) -> None:
        self.ids, self.n, self.base = ids, len(ids), base
        self.plain = ids.tolist()
        powers = np.full(self.n + 1, base, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(textkit.mix(ids.astype(np.uint64)) * self.powers[:-1], out=self.sums[1:])
        self._lists: tuple[list[int], list[int]] | None = None
        self.stretches: dict[int, tuple[int, int]] = {}

    def right(self, i: int, j: int) -> int:
        """How many words from i and from j > i on agree; both scans ask from the right to the left."""
        plain, n, p = self.plain, self.n, j - i
        low, high = self.stretches.get(p, (n, n))
        if low <= i < high:
            return high - i
        if high <= i:
            # Left from the other scan.
            low = high = n
        near = min(i + NEAR, n - p)
        k = i
        while k < near and plain[k] == plain[k + p]:
            k += 1
            if k == low:
                return self._known(p, i, high)
        if k < near or k == n - p:
            return k - i
        if self._lists is None:
            self._lists = self.sums.tolist(), self.powers.tolist()
        sums, powers = self._lists
        scale = powers[p]
        # The hashes agree up to ``a`` and differ at ``b``.
        a, b, step = k, n - p + 1, NEAR
        while a + step < b:
            if (sums[a + step] - sums[i]) * scale & _MASK == (sums[a + step + p] - sums[i + p]) & _MASK:
                a += step
                step *= 2
            else:
                b = a + step
        while b - a > 1:
            c = (a + b) // 2
            if (sums[c] - sums[i]) * scale & _MASK == (sums[c + p] - sums[i + p]) & _MASK:
                a = c
            else:
                b = c
        # What the hash says is compared up to the stretch that is known already.
        end = min(a, low)
        odd = np.flatnonzero(self.ids[k:end] != self.ids[k + p : end + p])
        if len(odd):
            return self._known(p, i, k + int(odd[0]))
        return self._known(p, i, high if end == low and low < high else a)

    def _known(self, p: int, i: int, high: int) -> int:
        self.stretches[p] = i, high
        return high - i

    def _same(self, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the hashes of the m words from i and from j > i on agree."""
        return (self.sums[i + m] - self.sums[i]) * self.powers[j - i] == self.sums[j + m] - self.sums[j]

    def both(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words before i and j > i agree, and how many from them on, by hash alone."""
        found = []
        for most, to_left in ((np.minimum(i, j), True), (self.n - j, False)):
            a, b = np.zeros(len(i), np.int64), most + 1
            step = 1
            while True:
                live = np.flatnonzero(b - a > 1)
                if not len(live):
                    break
                # Steps double until the first difference, then halve.
                c = np.where(b[live] == most[live] + 1, np.minimum(a[live] + step, b[live] - 1), (a[live] + b[live]) // 2)
                back = c if to_left else 0
                same = self._same(i[live] - back, j[live] - back, c)
                a[live], b[live] = np.where(same, c, a[live]), np.where(same, b[live], c)
                step *= 2
            found.append(a)
        return found[0], found[1]


def lyndon_ends(words: list[int], extensions: Extensions, reverse: bool) -> list[int]:
    """For each position the end of the longest Lyndon word that starts there; negative numbers end all before them.

    The stack is that of the Lyndon words to the right, each the end of the one before it.
    """
    w = [-c if c > 0 else -(1 << 62) for c in words] if reverse else [c if c > 0 else -1 for c in words]
    mark = -(1 << 62) if reverse else -1
    w.append(mark)
    n = len(words)
    ends = list(range(1, n + 1))
    right = extensions.right
    for i in range(n - 1, -1, -1):
        c = w[i]
        if c == mark:
            continue
        j = i + 1
        while True:
            d = w[j]
            if d < c:
                break
            if d == c:
                m = right(i, j)
                # Both stand in one text, so the mark behind it ends the later one at the latest.
                if w[j + m] < w[i + m]:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def _extended(ids: np.ndarray, start: int, end: int, p: int, roots: np.ndarray) -> np.ndarray:
    """The runs (start, end, period) of the roots' positions by comparing the words of [start, end) at the distance p."""
    odd = np.concatenate([[start - 1], np.flatnonzero(ids[start : end - p] != ids[start + p : end]) + start, [end - p]])
    k = np.searchsorted(odd, roots, side="left")
    # A root whose first words differ ends there; the stretch to its left may still be long.
    return np.stack([odd[k - 1] + 1, odd[k] + p, np.full(len(roots), p)], axis=1)


def find(ids: np.ndarray, shortest: int = SHORTEST, base: int = _BASE) -> np.ndarray:
    """All runs (start, end, least period) of at least ``shortest`` and two periods, by start and period; marks between texts are numbers under 1, all different."""
    if not len(ids):
        return np.zeros((0, 3), np.int64)
    extensions = Extensions(ids, base)
    found = []
    for reverse in (False, True):
        i, j = np.arange(len(ids)), np.array(lyndon_ends(extensions.plain, extensions, reverse), np.int64)
        p = j - i
        before = (i > 0) & (ids[i - 1] == ids[j - 1])
        behind = ids[i] == np.append(ids, -(1 << 62))[j]
        some = np.flatnonzero((ids > 0) & (before | behind | (p >= shortest)))
        i, j, p = i[some], j[some], p[some]
        left, right = extensions.both(i, j)
        length = left + right + p
        some = np.flatnonzero((length >= 2 * p) & (length >= shortest))
        found.append(np.stack([i[some] - left[some], j[some] + right[some], p[some], i[some]], axis=1))
    rows = np.concatenate(found)
    runs, which = np.unique(rows[:, :3], axis=0, return_inverse=True)
    exact = []
    for k, (start, end, p) in enumerate(runs.tolist()):
        if np.array_equal(ids[start : end - p], ids[start + p : end]):
            exact.append(runs[k : k + 1])
        else:
            exact.append(_extended(ids, start, end, p, np.unique(rows[which.ravel() == k, 3])))
    if not exact:
        return runs
    runs = np.unique(np.concatenate(exact), axis=0)
    length = runs[:, 1] - runs[:, 0]
    runs = runs[(length >= 2 * runs[:, 2]) & (length >= shortest)]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbers(w: textkit.Words, exact: bool) -> np.ndarray:
    """Numbers from 1 for the words of all texts, and a mark behind each text: by hash, or by bytes."""
    if exact:
        known: dict[bytes, int] = {}
        inverse = np.array([known.setdefault(w.data[a:b].tobytes(), len(known)) for a, b in zip(w.start, w.end, strict=True)], np.int64)
    else:
        inverse = np.unique(w.hash, return_inverse=True)[1]
    ids = np.empty(len(inverse) + len(w.count), np.int64)
    ids[np.arange(len(inverse)) + w.doc] = inverse.ravel() + 1
    ids[np.cumsum(w.count) + np.arange(len(w.count))] = -np.arange(len(w.count))
    return ids


def of_words(w: textkit.Words, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all texts: text number, (start, length, period) in it; and which words stay."""
    for exact in (False, True):
        ids = _numbers(w, exact)
        runs = find(ids, shortest)
        place = np.cumsum(w.count + 1) - (w.count + 1)
        doc = np.searchsorted(place, runs[:, 0], side="right") - 1 if len(runs) else np.zeros(0, np.int64)
        first = runs[:, 0] - doc
        # The same words by their bytes, not only by their hashes.
        if exact or all(w.text(a, a + e - s - p) == w.text(a + p, a + e - s) for a, (s, e, p) in zip(first.tolist(), runs.tolist(), strict=True)):
            break
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    stays = (np.cumsum(change[:-1]) == 0)[np.arange(len(w.doc)) + w.doc]
    return doc, np.stack([runs[:, 0] - place[doc], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1), stays


def repetitions(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, runs (start, length, period; by start and period), kept_text.

    Words are numbered from 0. ``kept_text`` has the words, joined by one space, that no run
    contains behind its first period.
    """

    def chunk(part: pa.RecordBatch) -> pa.RecordBatch:
        w = textkit.words(part.column("text"))
        doc, runs, stays = of_words(w, shortest)
        struct = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)), struct)
        texts = []
        for a, n in zip(w.first.tolist(), w.count.tolist(), strict=True):
            own = stays[a : a + n]
            if own.all():
                texts.append(w.text(a, a + n))
            else:
                # Stretches of kept words.
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))) + a
                texts.append(" ".join(w.text(x, y) for x, y in edge.reshape(-1, 2).tolist()))
        return pa.record_batch({"doc_id": part.column("doc_id"), "runs": lists, "kept_text": pa.array(texts, pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in textkit.chunks(batch.column("text")):
                yield chunk(batch.slice(a, b - a))

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(textkit.lean(run), f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, kept_text string")


def planted(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text), a tenth of them by their ids with a periodic end; null ids have none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    n = F.size("w")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    rows = rows.select("doc_id", "text", "w", F.when(n > 0, a).cast("int").alias("a"), F.when(n > 0, p).cast("int").alias("p"))
    n, a, p = F.size("w"), F.col("a"), F.col("p")
    period = F.slice("w", a + 1, p)
    end = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return rows.select("doc_id", F.when(p.isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), a), end), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, with periodic ends planted in a tenth of them."""
    rows = repetitions(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("b"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.p")
    return rows.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * b.length div -b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Equal words at a distance: stretches of equal 6-grams, as every run has two that are a period apart.
_ORACLE = r"""WITH given AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(list_filter(string_split(doc_id::VARCHAR, ''), lambda c: c <> ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END)) AS h FROM documents),
shaped AS (SELECT *, CASE WHEN h % 10 = 0 AND len(v) > 0 THEN (h // 10) % len(v) END AS a FROM given),
periods AS (SELECT *, 1 + (len(v) - a) // (3 + (h // 10) % 8) AS p FROM shaped),
docs AS MATERIALIZED (SELECT r, doc_id, CASE WHEN a IS NULL THEN v ELSE list_transform(range(len(v)), lambda i: v[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM periods),
grams AS MATERIALIZED (SELECT r, i, hash(w[i + 1 : i + 6]) AS g FROM (SELECT r, w, unnest(range(len(w) - 5)) AS i FROM docs WHERE len(w) >= 12)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
stretches AS (SELECT r, q, min(i) AS s, count(*) + 5 + q AS l FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k),
periodic AS MATERIALIZED (SELECT * FROM stretches WHERE l >= 12 AND l >= 2 * q),
runs AS MATERIALIZED (SELECT * FROM periodic x WHERE NOT EXISTS (SELECT 1 FROM periodic y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM docs) ANTI JOIN dropped USING (r, i) GROUP BY r),
told AS (SELECT r, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, min(struct_pack(l := -l, s := s, q := q)) AS b FROM runs GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, (-b.l)::BIGINT AS length, b.q::BIGINT AS period, (1000 * -b.l // b.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (r) LEFT JOIN kept USING (r)"""

QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES = {"op11_periodic_runs": _ORACLE}
