"""Vector code compression: product codes of integer vectors, exact to the last tie.

Each vector becomes integers and is cut into equal parts; each part is coded by the index of
the nearest entry of its position's codebook. The nearest entry is found in two steps:

* Screening. One float32 matrix product gives half the squared norm of each entry less its
  inner product with each part. For ``m`` components and the unit roundoff ``u`` = 2**-24 the
  computed value is within ``E = g |x| |b| + u h + u (h + |x| |b|) (1 + 2 g)`` of the true one,
  with ``g = (m + 2) u / (1 - (m + 2) u)`` for the product in any order of summation (two of the
  m + 2 for rounding the integers to float32), ``h`` the largest half norm and ``|b|`` the
  largest norm of an entry.
* Decision. Every entry whose interval reaches that of the best is evaluated again in int64,
  and the least of equal distances has the lowest index.

The codebooks are trained by rounds over the whole table: tasks add up the parts of each entry
(one row an entry and task), Spark adds up the tasks, and only the new codebooks, whose size
doesn't depend on the data, come to the driver.

Defined results: vectors that are null, empty, of a length that the parts don't divide, or that
hold null or non-finite components are dropped, as are those of another length than the first
kept one's. Ids may be null (behind all others) or repeat (ordered by content then); fewer rows
than entries give smaller codebooks; an empty table gives an empty result. Components so large
that a squared distance could leave 64 bits count as the largest allowed. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import textkit
from webquarry.llm.shared import cut

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Rows that are screened together.
ROWS = 4096
#: Entries that are evaluated together.
PAIRS = 1 << 17
#: Sums of so many labels are sent to all tasks; those of more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def largest(length: int) -> int:
    """The largest component: squared distances of vectors of this length stay below 2**62."""
    return 1 << min(30, (62 - (length - 1).bit_length()) // 2 - 1)


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """The rows (vec_id, label, embedding) that can be coded: vec_id, label, v (binary, little-endian int32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            offsets, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.values
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x) | ~flat.is_valid().to_numpy(zero_copy_only=False))])
            size = np.diff(offsets)
            good = np.flatnonzero(valid & (size > 0) & (size % parts == 0) & (bad[offsets[1:]] == bad[offsets[:-1]]))
            data = []
            for i in good:
                most = largest(int(size[i]))
                with np.errstate(over="ignore"):
                    data.append(np.clip(np.floor(x[offsets[i] : offsets[i + 1]] * scale), -most, most).astype("<i4").tobytes())
            yield pa.record_batch({"vec_id": batch.column("vec_id").take(pa.array(good)), "label": batch.column("label").take(pa.array(good)), "v": pa.array(data, pa.binary())})

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(textkit.lean(run), f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, v binary")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the lowest index of a nearest row of ``book``, and its squared distance (all int64)."""
    # Of equal entries only the first can win.
    _, first = np.unique(book, axis=0, return_index=True)
    first.sort()
    b = book[first]
    m = x.shape[1]
    u = 2.0**-24
    g = (m + 2) * u / (1 - (m + 2) * u)
    half = 0.5 * (b.astype(np.float64) ** 2).sum(1)
    h, norm = half.max(), np.sqrt(2 * half.max())
    index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        own = x[at : at + ROWS]
        score = half.astype(np.float32) - own.astype(np.float32) @ b.astype(np.float32).T
        product = np.sqrt((own.astype(np.float64) ** 2).sum(1)) * norm
        # A little more than the bound, for the bound's own rounding.
        bound = (g * product + u * h + u * (h + product) * (1 + 2 * g)) * (1 + 1e-6)
        reach = np.nextafter((score.min(1) + 2 * bound).astype(np.float32), np.float32(np.inf))
        row, entry = np.nonzero(score <= reach[:, None])
        distance = np.empty(len(row), np.int64)
        for k in range(0, len(row), PAIRS):
            d = own[row[k : k + PAIRS]] - b[entry[k : k + PAIRS]]
            distance[k : k + PAIRS] = np.einsum("ij,ij->i", d, d)
        # Rows and, in a row, entries ascend; each row has an entry.
        least = np.minimum.reduceat(distance, np.searchsorted(row, np.arange(len(own))))
        hit = np.flatnonzero(distance == least[row])
        index[at : at + ROWS] = first[entry[hit[np.searchsorted(row[hit], np.arange(len(own)))]]]
        error[at : at + ROWS] = least
    return index, error


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Vectors as (rows, parts, components of a part) int64."""
    data = b"".join(x.as_py() for x in column)
    return np.frombuffer(data, "<i4").astype(np.int64).reshape(len(column), parts, -1)


def improved(ints: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, components) after one round over all rows."""
    parts, entries, m = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, m), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("v"), parts)
            for p in range(parts):
                index, _ = nearest(x[:, p], books[p])
                counts[p] += np.bincount(index, minlength=entries)
                order = np.argsort(index, kind="stable")
                used, start = np.unique(index[order], return_index=True)
                sums[p, used] += np.add.reduceat(x[order, p], start)
        p, e = np.nonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * m), pa.array(sums[p, e].ravel()))
        yield pa.record_batch({"p": pa.array(p.astype(np.int32)), "e": pa.array(e.astype(np.int32)), "n": pa.array(counts[p, e]), "s": lists})

    found = ints.select("v").mapInArrow(textkit.lean(run), "p int, e int, n long, s array<long>")
    total = found.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(m)]).alias("s"))
    out = books.copy()
    # A row an entry at most.
    for r in total.collect():
        out[r.p, r.e] = np.array(r.s, np.int64) // r.n
    return out


def trained(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components) of the rows of ``ints``, all of one length; no entries without rows."""
    seeds = ints.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    if not seeds:
        return np.zeros((parts, 0, 0), np.int64)
    books = _matrix(pa.array([bytes(r.v) for r in seeds], pa.binary()), parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = improved(ints, books)
    return books


def coded(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """``ints`` with the indexes of the nearest entries as ``codes`` (binary, a byte a part) and the summed squared distances as ``error``."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = np.zeros((len(batch), parts), np.uint8), np.zeros(len(batch), np.int64)
            if len(batch):
                x = _matrix(batch.column("v"), parts)
                for p in range(parts):
                    codes[:, p], e = nearest(x[:, p], books[p])
                    error += e
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error)})

    return ints.mapInArrow(textkit.lean(run), f"vec_id long, label {ints.schema['label'].dataType.simpleString()}, codes binary, error long")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` (codes) with ``approximate``, the vectors that the codes stand for (array<double>)."""
    entry = [F.array(*[F.array(*[F.lit(float(v) / scale) for v in e]) for e in book]) for book in books]
    return codes.withColumn("approximate", F.concat(*[entry[p][F.conv(F.hex(F.substring("codes", p + 1, 1)), 16, 10).cast("int")] for p in range(len(books))]))


def books_text(books: np.ndarray) -> str:
    """All components in decimal by part, entry and place."""
    return ",".join(map(str, books.ravel().tolist()))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, label, embedding), and the codebooks: vec_id, label, codes, error, label_error."""
    if entries > 256:
        raise ValueError("a code has one byte a part")
    # Read and turned into integers once; all rounds read these.
    ints = cut(integers(vectors, parts, scale))
    length = ints.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.octet_length("v")).first()
    ints = ints.where(F.octet_length("v") == F.lit(length[0] if length else 0))
    books = trained(ints, parts, entries, rounds)
    rows = cut(coded(ints, books))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = cut(rows.groupBy(F.col("label").alias("_label")).agg(F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error")))
    small = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return rows.join(F.broadcast(labels) if small else labels, rows["label"].eqNullSafe(labels["_label"])).drop("_label"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as four bytes each, with the errors and the digest of the codebooks."""
    rows, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by plain SQL: every distance of every round."""
    nearest_sql = """n{r} AS (SELECT id, p, min(struct_pack(d := d, k := k)) AS b FROM (
 SELECT x.id, x.p, c.k, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN c{r} c ON c.p = x.p) GROUP BY id, p)"""
    moved_sql = """c{s} AS (SELECT c.p, c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
 SELECT p, k, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS v FROM (
  SELECT p, k, j, sum(e) AS s, count(*) AS n FROM (
   SELECT x.p, n{r}.b.k AS k, unnest(x.v) AS e, generate_subscripts(x.v, 1) AS j FROM x JOIN n{r} ON n{r}.id = x.id AND n{r}.p = x.p) GROUP BY p, k, j) GROUP BY p, k) m ON m.p = c.p AND m.k = c.k)"""
    steps = []
    for r in range(ROUNDS):
        steps += [nearest_sql.format(r=r), moved_sql.format(r=r, s=r + 1)]
    steps.append(nearest_sql.format(r=ROUNDS))
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, list_transform(embedding, lambda y: CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) t(p)),
c0 AS (SELECT p, id AS k, v FROM x WHERE id < {ENTRIES}), {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
coded AS (SELECT id, string_agg(printf('%02x', b.k), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM c{ROUNDS}) AS codebooks_sha256 FROM coded JOIN kept USING (id)"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": _oracle()}
