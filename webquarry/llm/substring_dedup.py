"""Substring deduplication with suffix automata of reference shards.

A window is 13 consecutive words of one document; a word goes if a window that covers it also
starts in a document with a smaller id. What is left of a document is its other words.

An automaton of the whole corpus, or every shard's automaton sent to every document, would
grow with the square of the corpus. So text and references are brought together by anchors
first: the anchor of a window is the least hash among its nine runs of five words, so equal
windows have equal anchors. Only anchors of two or more documents matter; the rest of the text
never leaves its task. Around such an anchor each document gives a span, the run of windows
that share it; a task keeps equal spans once, with the least id that it saw, so a passage that
a third of all documents repeat is a row a task. Spans of anchors that more than a hundredth of all
documents have are keyed by
themselves, which spreads common phrases over all tasks; only the distinct ones of them are cut into
windows, each of which has a least id of its own, so a document's rows are spans and not windows
also there. As the limit is a share of the table, the same phrases are cut in a table of any size, and
their rows grow with the table; a fixed number of documents would be passed by more and more
phrases. Whole copies of a
document are found by hash before that and need no comparison. The references are
sharded by anchor; a task builds a suffix automaton for each shard of bounded size, streams
the shard's spans through it in the order of their ids, takes the matching statistics (the
longest suffix known from smaller ids at each word) and marks the windows where they reach
13 words. An anchor with more words than a shard may have is dealt to several by runs of nine words,
and then by whole windows. The marks go back to the documents by key.

Defined results: null texts and texts of fewer than 13 words lose nothing; repeated windows
inside one document are kept; rows with one doc_id are one document for the comparison, and
each such row gets its own result; rows without an id are documents by their texts, before all
others and in the order of a hash; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import textkit
from webquarry.llm.shared import text_key

WINDOW = 13
GRAM = 5
#: An anchor is hot in more documents than this and than a share of all; beyond a last number it is hot
#: in any table, as a task holds the spans of an anchor that isn't.
HOT = 500
HOT_SHARE = 100
HOT_LAST = 200_000
NO_ID = -(1 << 63)
#: Tasks that a large group of whole copies is dealt to.
SALTS = 16
SPAN_WINDOWS = 48
SHARD_WORDS = 20_000


def _anchors(w: textkit.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window, and its anchor."""
    m = len(w.hash) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, _ = textkit.ngrams(w.hash, np.zeros(len(w.hash), np.int8), GRAM)
    wide, low = 1, g
    while wide * 2 <= window - GRAM + 1:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    rest = window - GRAM + 1 - wide
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    at = np.flatnonzero(w.doc[:m] == w.doc[window - 1 :])
    return at, low[at]


def _mark(anchor: np.ndarray) -> np.ndarray:
    """The 48 bits of an anchor by which it is counted; two anchors of one mark only cost a comparison of their spans."""
    return textkit.signed(anchor.view(np.uint64) >> np.uint64(16))


class SuffixAutomaton:
    """Suffix automaton of several word sequences; a sequence never continues another."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[str]) -> None:
        """Adds one sequence and all its parts."""
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _split(self, p: int, q: int, word: str) -> int:
        """The state of exactly length[p] + 1 words that q stands for after p."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: str) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, known, word)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def matching(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest known sequence that ends there."""
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(word)
            state, length = (to, length + 1) if to is not None else (0, 0)
            out.append(length)
        return out


def _marks(shard: list[tuple[int, str]], window: int) -> list[int]:
    """For spans (first id, text), a bit for each window that a span with a smaller first id has."""
    out = [0] * len(shard)
    order = sorted(range(len(shard)), key=lambda i: shard[i][0])
    automaton, i = SuffixAutomaton(), 0
    while i < len(order):
        j = i
        while j < len(order) and shard[order[j]][0] == shard[order[i]][0]:
            j += 1
        fresh = []
        for k in order[i:j]:
            words = shard[k][1].split(" ")
            ends = automaton.matching(words)[window - 1 :]
            out[k] = sum(1 << n for n, length in enumerate(ends) if length >= window)
            if out[k] + 1 != 1 << len(ends):
                fresh.append(words)
        for words in fresh:
            automaton.add(words)
        i = j
    return out


def _bounded_marks(spans: list[tuple[int, str]], window: int, gram: int = GRAM, most: int = SHARD_WORDS) -> list[int]:
    """``_marks`` of any number of spans, by automata of about ``most`` words.

    Equal windows have the same least run of ``gram`` words, so windows meet in the shard of that run.
    Runs that are in too many words get longer, up to the window, of which an automaton holds one.
    """
    if gram >= window or sum(span.count(" ") + 1 for _, span in spans) <= most:
        return _marks(spans, window)
    gram = min(gram + 4, window)
    parts: dict[int, list[tuple[int, int, int, str]]] = defaultdict(list)
    for i, (doc, span) in enumerate(spans):
        words = span.split(" ")
        runs = [hash(" ".join(words[k : k + gram])) for k in range(len(words) - gram + 1)]
        least = [min(runs[k : k + window - gram + 1]) for k in range(len(words) - window + 1)]
        a = 0
        for b in range(1, len(least) + 1):
            if b == len(least) or least[b] != least[a]:
                parts[least[a]].append((i, a, doc, " ".join(words[a : b - 1 + window])))
                a = b
    out = [0] * len(spans)
    shard: list[tuple[int, int, int, str]] = []

    def close() -> None:
        marks = _bounded_marks([(doc, span) for _, _, doc, span in shard], window, gram, most)
        for (i, a, _, _), mark in zip(shard, marks, strict=True):
            out[i] |= mark << a
        shard.clear()

    size = 0
    for part in parts.values():
        if len(part) == 1:
            continue
        more = sum(span.count(" ") + 1 for _, _, _, span in part)
        # A part that is too large is a shard of its own, and is split further.
        if shard and size + more > most:
            close()
            size = 0
        shard.extend(part)
        size += more
    if shard:
        close()
    return out


def _digests(words: str) -> tuple[int, int]:
    both = hashlib.blake2b(words.encode(), digest_size=16).digest()
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def _spans(docs: DataFrame, window: int, also: tuple[str, ...] = (), most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Occurrences of spans in ``docs`` (doc_id, h1, text, shared, common), and each task's distinct ones.

    The occurrences are (key, th, doc_id, h1, start, count), the distinct spans (key, th, first_doc,
    span, hot) with the least id that the task saw. ``shared``: anchors of other documents too;
    ``common``: those of very many, whose spans are hot and have a hash of the span as their key.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, h1 = batch.column("text"), batch.column("doc_id"), batch.column("h1")
            shared, common = batch.column("shared"), batch.column("common")
            for i, j in textkit.chunks(texts):
                w = textkit.words(texts.slice(i, j - i))
                at, anchor = _anchors(w, window)
                anchor = textkit.signed(anchor)
                rows: list[tuple[int, int, int, int, str, bool, int]] = []
                edges = np.searchsorted(w.doc[at], np.arange(j - i + 1))
                for d in range(j - i):
                    here, its = at[edges[d] : edges[d + 1]], anchor[edges[d] : edges[d + 1]]
                    if not len(here):
                        continue
                    mark = _mark(its)
                    known = np.isin(mark, shared[i + d].values.to_numpy())
                    frequent = np.isin(mark, common[i + d].values.to_numpy())
                    turn = its[1:] != its[:-1]
                    run = np.flatnonzero(known & np.concatenate([[True], turn]))
                    stop = np.flatnonzero(known & np.concatenate([turn, [True]])) + 1
                    for a, b in zip(run.tolist(), stop.tolist(), strict=True):
                        for s in range(a, b, SPAN_WINDOWS):
                            e = min(b, s + SPAN_WINDOWS)
                            first = int(here[s])
                            words = w.text(first, first + (e - s) + window - 1)
                            key, th = _digests(words)
                            rows.append((key if frequent[a] else int(its[a]), th, first - int(w.first[d]), e - s, words, bool(frequent[a]), i + d))
                if rows:
                    key, th, start, count, text, hot, row = zip(*rows, strict=True)
                    take = pa.array(row)
                    yield pa.record_batch({"key": pa.array(key, pa.int64()), "th": pa.array(th, pa.int64()), "doc_id": ids.take(take), "h1": h1.take(take), "start": pa.array(start, pa.int32()), "count": pa.array(count, pa.int32()), "span": pa.array(text, pa.string()), "hot": pa.array(hot, pa.bool_())})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, str, bool]] = {}

        def flush() -> pa.RecordBatch:
            keys, values = list(held), list(held.values())
            held.clear()
            return pa.record_batch({"key": pa.array([k[0] for k in keys], pa.int64()), "th": pa.array([k[1] for k in keys], pa.int64()), "first_doc": pa.array([v[0] for v in values], pa.int64()), "span": pa.array([v[1] for v in values], pa.string()), "hot": pa.array([v[2] for v in values], pa.bool_())})

        for batch in spans(batches):
            for key, th, doc, span, hot in zip(*(batch.column(c).to_pylist() for c in ("key", "th", "doc_id", "span", "hot")), strict=True):
                known = held.get((key, th))
                if known is None or doc < known[0]:
                    held[key, th] = (doc, span, hot)
            if len(held) >= most:
                yield flush()
        yield flush()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches):
            yield batch.drop_columns(["span", "hot"])

    rows = docs.select("doc_id", "h1", "text", "shared", "common", *also)
    distinct = rows.transform(textkit.mapped, combine, "key long, th long, first_doc long, span string, hot boolean")
    return rows.transform(textkit.mapped, places, "key long, th long, doc_id long, h1 long, start int, count int"), distinct


def _marked(references: DataFrame, window: int) -> DataFrame:
    """(key, th, first_doc, mask): every distinct span with its least id and the marks of its windows.

    Spans that aren't hot are compared with those of their anchor. A hot one is alone under its
    key; its windows are compared as rows, with no more of them than the distinct spans have.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, int, str]] = []  # spans of anchors with several
        done: list[tuple[int, int, int, int]] = []
        group: dict[int, tuple[int, str]] = {}
        now, words = None, 0

        def close() -> int:
            if len(group) == 1:
                ((th, (doc, _)),) = group.items()
                done.append((now, th, doc, 0))
                return 0
            size = sum(span.count(" ") + 1 for _, span in group.values())
            if size > SHARD_WORDS:
                marks = _bounded_marks(list(group.values()), window)
                done.extend((now, th, doc, mark) for (th, (doc, _)), mark in zip(group.items(), marks, strict=True))
                return 0
            shard.extend((now, th, doc, span) for th, (doc, span) in group.items())
            return size

        def flush() -> pa.RecordBatch:
            marks = _marks([(x[2], x[3]) for x in shard], window)
            rows = done + [(x[0], x[1], x[2], m) for x, m in zip(shard, marks, strict=True)]
            shard.clear()
            done.clear()
            return pa.record_batch({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("key", "th", "first_doc", "mask"))})

        for batch in batches:
            for key, th, doc, span in zip(*(batch.column(c).to_pylist() for c in ("key", "th", "first_doc", "span")), strict=True):
                if key != now:
                    if group:
                        words += close()
                        group.clear()
                    now = key
                    if words >= SHARD_WORDS or len(done) >= 50_000:
                        yield flush()
                        words = 0
                known = group.get(th)
                if known is None or doc < known[0]:
                    group[th] = (doc, span)
        if group:
            close()
        yield flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[int, int], tuple[int, str]] = {}
        rows: list[tuple[int, int, int, int, int, int]] = []
        now = None

        def close() -> None:
            for (key, th), (doc, span) in group.items():
                words = span.split(" ")
                rows.extend((*_digests(" ".join(words[i : i + window])), key, th, doc, 1 << i) for i in range(len(words) - window + 1))
            group.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("w1", "w2", "key", "th", "first_doc", "bit"))})
            rows.clear()
            return batch

        for batch in batches:
            batch = batch.filter(batch.column("hot"))
            for key, th, doc, span in zip(*(batch.column(c).to_pylist() for c in ("key", "th", "first_doc", "span")), strict=True):
                if key != now:
                    close()
                    now = key
                    if len(rows) >= 50_000:
                        yield flush()
                known = group.get((key, th))
                if known is None or doc < known[0]:
                    group[key, th] = (doc, span)
        close()
        yield flush()

    # Both read all columns of one exchange.
    dealt = references.repartition("key").sortWithinPartitions("key")
    marked = dealt.transform(textkit.mapped, match, "key long, th long, first_doc long, mask long")
    rows = dealt.transform(textkit.mapped, windows, "w1 long, w2 long, key long, th long, first_doc long, bit long")
    least = rows.groupBy("w1", "w2").agg(F.min("first_doc").alias("least"), F.max("first_doc").alias("most")).where("least < most").drop("most")
    later = rows.join(least, ["w1", "w2"]).where("first_doc > least").groupBy("key", "th").agg(F.bit_or("bit").alias("more"))
    return marked.join(later, ["key", "th"], "left").select("key", "th", "first_doc", F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0))).alias("mask"))


def _seen_anchors(docs: DataFrame, window: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(anchor, doc_id), the mark of each anchor of a document once."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in textkit.chunks(texts):
                w = textkit.words(texts.slice(i, j - i))
                at, anchor = _anchors(w, window)
                if not len(at):
                    continue
                doc, anchor = w.doc[at], _mark(anchor).view(np.uint64)
                turn = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                doc, anchor = doc[turn], anchor[turn]
                _, once = np.unique(textkit.mix(textkit.mix(anchor) + doc.astype(np.uint64)), return_index=True)
                yield pa.record_batch({"anchor": textkit.signed(anchor[once]), "doc_id": ids[i:j][doc[once]]})

    return docs.select("doc_id", "h1", "text", *also).transform(textkit.mapped, anchors, "anchor long, doc_id long")


def removed_windows(docs: DataFrame, window: int = WINDOW, hot: int = HOT, also: tuple[str, ...] = ()) -> DataFrame:
    """Per id of ``docs`` (doc_id, h1, text) with windows to remove: spans array<struct<h1, start, mask>>.

    All joins with the texts are by doc_id alone, so that one exchange of them serves all; ``also``
    are columns that the caller's join needs, read here too, as else the exchanges would differ.
    """
    seen = _seen_anchors(docs, window, also)
    shared = seen.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > hot).alias("hot"))
    # As many anchors as the document has runs of windows at most.
    by_doc = seen.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("common"))
    occurrences, spans = _spans(docs.join(by_doc, "doc_id"), window, also)
    marked = _marked(spans, window)
    every = F.expr("shiftleft(1L, count) - 1")
    found = occurrences.join(marked, ["key", "th"]).withColumn("mask", F.when(F.col("doc_id") > F.col("first_doc"), every).otherwise(F.col("mask")))
    return found.where("mask <> 0").groupBy("doc_id").agg(F.collect_list(F.struct("h1", "start", "mask")).alias("spans"))


def _covered(n: int, starts: list[int], masks: list[int], window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for start, mask in zip(starts, masks, strict=True):
        while mask:
            low = (mask & -mask).bit_length() - 1
            edge[start + low] += 1
            edge[start + low + window] -= 1
            mask &= mask - 1
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, window: int = WINDOW, hot: int = HOT, carried: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text and its ``carried`` columns.

    The rows are counted at once. ``hot``: the least number of documents of a hot anchor in a small table.
    ``kept_text`` is the input text where nothing goes, else the kept words joined by one space.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, total, gone = [], [], []
            for value, h1, copy, spans in zip(*(batch.column(c) for c in ("text", "h1", "copy", "spans")), strict=True):
                whole = value.as_py()
                words = [] if whole is None else whole.encode().split()
                lost = 0
                if copy.as_py():
                    lost = len(words) if len(words) >= window else 0
                    whole = whole if not lost else ""
                elif spans.is_valid:
                    mine = [x for x in spans.as_py() if x["h1"] == h1.as_py()]
                    out = _covered(len(words), [x["start"] for x in mine], [x["mask"] for x in mine], window)
                    lost = int(out.sum())
                    whole = whole if not lost else b" ".join(x for x, o in zip(words, out.tolist(), strict=True) if not o).decode()
                text.append(whole)
                total.append(len(words))
                gone.append(lost)
            yield pa.record_batch({"doc_id": batch.column("own_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(text, pa.string()), **{c: batch.column(c) for c in carried}})

    key = text_key()
    given = F.col("doc_id").cast("long")
    # Never null, so that no join adds a filter and the exchange of the texts is the same in all of them.
    own_id = F.coalesce(given, F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 3)).alias("doc_id")
    keyed = docs.select(own_id, given.alias("own_id"), "text", key[0], *carried)
    hashed = docs.select(own_id, *key)
    # Whole copies of a text with a smaller id lose every window; only the first of them is looked into.
    first = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # A third of all rows may be one group, so each group's number is sent to several tasks.
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = first.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    copies = salted.join(first, ["h1", "h2", "salt"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("h1").alias("copies"))
    rows = keyed.join(copies, "doc_id", "left").withColumn("copy", F.coalesce(F.array_contains("copies", F.col("h1")), F.lit(False))).drop("copies")
    hot = max(hot, min(docs.count() // HOT_SHARE, HOT_LAST))
    found = removed_windows(rows.where("NOT copy"), window, hot, ("own_id", *carried))
    kind = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    kept = rows.join(found, "doc_id", "left").select("own_id", "h1", "text", "copy", "spans", *carried)
    return kept.transform(textkit.mapped, keep, f"doc_id long, n_words long, n_removed long, kept_text string{kind}")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the digest of the words that stay."""
    kept = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # One space between words, none around them.
    words = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos
  FROM windows JOIN firsts USING (win) WHERE first_doc < doc_id),
listed AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT coalesce(list_contains(gone, p[2]), false)), lambda p: p[1]), ' ')) AS kept_sha256
FROM words d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""

QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES = {"op6_substring_dedup": ORACLE}
