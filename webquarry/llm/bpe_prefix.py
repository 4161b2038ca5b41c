"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the encoding's last token is unique: the token t that ends
there, that is itself an encoding of its bytes, and that may follow the last token of the
prefix before it, meaning that the merges never join the two at their border. A table of last
tokens per prefix therefore holds the encodings of all prefixes: walking back from any
position gives its tokens, appending bytes only adds entries, and after an edit only the
entries behind it are computed again, until they repeat the old ones.

Texts are cut by the vocabulary's pattern first and each match is encoded separately.

Defined results: a null text is an empty one and has no tokens; special tokens' strings are
ordinary text; bytes outside UTF-8 can be encoded and decoded by the class; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from webquarry.llm import textkit

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that are remembered, those of the latest chunk of texts in any case.
CACHE_PIECES = 100_000
#: Longer pieces are not remembered.
SHORT_CHARS = 64
#: Characters of texts that are cut into pieces and encoded together.
CHUNK_CHARS = 1 << 20
#: Remembered verdicts on pairs of neighbouring tokens.
PAIRS = 200_000


class PrefixBpe:
    """A byte-pair vocabulary given as ranks: bytes of a token -> its id, lower ids merged first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        size = max(self.bytes) + 1
        # The halves of each token's last merge, -1 for single bytes; joined has their tokens.
        self.left, self.right = [-1] * size, [-1] * size
        self.joined: dict[int, int] = {}
        #: Tokens that are the encoding of their own bytes, so that they can stand in an encoding.
        self.usable: dict[bytes, int] = {}
        # Lower ids first: the halves of a token's last merge have lower ids than it has.
        for token, value in sorted(self.bytes.items()):
            if len(value) == 1:
                self.usable[value] = token
                continue
            for cut in range(1, len(value)):
                a, b = self.usable.get(value[:cut]), self.usable.get(value[cut:])
                if a is not None and b is not None and self.follows(a, b):
                    self.left[token], self.right[token] = a, b
                    self.joined[a << 32 | b] = token
                    self.usable[value] = token
                    break
        self.length = [0] * size
        #: The usable tokens from their ends: byte -> (branches before it, the token that begins there or -1).
        self.endings: dict[int, tuple[dict, int]] = {}
        for value, token in sorted(self.usable.items(), key=lambda x: x[0][::-1]):
            self.length[token] = len(value)
            branches = self.endings
            for byte in value[:0:-1]:
                branches = branches.setdefault(byte, ({}, -1))[0]
            branches[value[0]] = (branches.get(value[0], ({},))[0], token)
        #: Verdicts of follows() on pairs of tokens, at most PAIRS.
        self.pairs: dict[int, bool] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether b can be the token after a in an encoding.

        It can if no merge ever crosses their border. Undoing the later of the two tokens' last
        merges, step by step, visits all pairs of parts that stand at the border at one time; a
        pair is there from its own making until the rank ``limit`` of the merge undone last, so
        only a joint merge of a lower rank would have been done.
        """
        left, right, joined, limit = self.left, self.right, self.joined, 1 << 62
        while True:
            merged = joined.get(a << 32 | b)
            if merged is not None and merged < limit:
                return False
            # With equal ids the left one is merged first, as it stands first.
            if left[a] >= 0 and (a > b or left[b] < 0):
                if a < limit:
                    limit = a
                a = right[a]
            elif left[b] >= 0:
                if b < limit:
                    limit = b + 1
                b = left[b]
            else:
                return True

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Adds to ``last``, the last tokens of the first prefixes of ``data``, those of the others.

        A walk back from the end of each prefix names the tokens that end there, the shortest
        first; the one that may follow the last token of the prefix before it is the only one.
        The table is one number a byte, however long the piece is.
        """
        pairs = self.pairs
        for end in range(len(last), len(data) if upto is None else upto):
            branches = self.endings
            for start in range(end, -1, -1):
                found = branches.get(data[start])
                if found is None:
                    raise ValueError("a byte has no token")
                branches, token = found
                if token < 0:
                    continue
                if start:
                    pair = last[start - 1] << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.follows(last[start - 1], token)
                    if not fits:
                        continue
                last.append(token)
                break
            else:
                raise ValueError("a byte has no token")
        return last

    def tokens(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes (all), read back from its last tokens."""
        at, out = len(last) if end is None else end, []
        while at > 0:
            out.append(last[at - 1])
            at -= self.length[last[at - 1]]
        return out[::-1]

    def replace(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """``data`` with bytes start..end replaced, and its table, reusing both sides of the edit.

        Behind the edit an entry depends on at most the ``longest`` entries before it, so once
        that many repeat the old ones, all later ones do.
        """
        changed = data[:start] + new + data[end:]
        shift, table, same = len(new) - (end - start), last[:start], 0
        while len(table) < len(changed):
            done = len(table)
            self.extend(changed, table, min(len(changed), done + 2 * self.longest))
            for at in range(done, len(table)):
                behind = at - self.length[table[at]] + 1 >= start + len(new)
                same = same + 1 if behind and at - shift >= 0 and table[at] == last[at - shift] else 0
                if same >= 2 * self.longest:
                    return changed, table[: at + 1] + last[at + 1 - shift :]
        return changed, table

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token itself is that token."""
        own = self.ranks.get(data)
        return [own] if own is not None else self.tokens(self.extend(data, []))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    """The vocabulary of a file of lines ``base64(bytes) rank``; once per Python worker."""
    with open(path, "rb") as lines:
        return PrefixBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class Pieces:
    """What is made of the ids of pieces, remembered for at most about ``most`` of them.

    New pieces are encoded in sorted order, each on the table of the one before as far as both
    begin alike. When too many are held, those of the latest texts stay.
    """

    def __init__(self, bpe: PrefixBpe, made: Callable[[list[int]], object] = tuple, most: int = CACHE_PIECES) -> None:
        self.bpe, self.made, self.most = bpe, made, most
        self.held: dict[str, object] = {}
        self.long: list[str] = []

    def of(self, lists: list[list[str]]) -> dict[str, object]:
        """A dictionary with all pieces of the lists; valid until the next call."""
        for piece in self.long:
            del self.held[piece]
        wanted: set[str] = set().union(*lists)
        fresh = sorted(wanted.difference(self.held))
        self.long = [p for p in fresh if len(p) > SHORT_CHARS]
        if len(self.held) + len(fresh) > self.most:
            self.held = {p: x for p, x in self.held.items() if p in wanted}
        ranks, extend, tokens = self.bpe.ranks, self.bpe.extend, self.bpe.tokens
        last: list[int] = []
        before = b""
        for piece in fresh:
            data = piece.encode("utf-8")
            own = ranks.get(data)
            if own is None:
                same = 0
                for x, y in zip(before, data, strict=False):
                    if x != y:
                        break
                    same += 1
                del last[same:]
                before = data
            self.held[piece] = self.made([own] if own is not None else tokens(extend(data, last)))
        return self.held


def matches(texts: Iterator[str | None], pattern: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The pattern's matches in order, as lists of (text number, matches) of about CHUNK_CHARS together.

    The matches of a long text come in several parts, so that they aren't all held at once.
    """
    compiled = regex.compile(pattern)
    group: list[tuple[int, list[str]]] = []
    room = CHUNK_CHARS
    for row, text in enumerate(texts):
        text = text or ""
        if len(text) <= CHUNK_CHARS:
            parts = iter([compiled.findall(text)])
        else:
            found = (m.group() for m in compiled.finditer(text))
            parts = iter(lambda it=found: list(islice(it, CHUNK_CHARS // 4)), [])
        for part in parts:
            group.append((row, part))
            room -= min(len(text), CHUNK_CHARS)
            if room <= 0:
                yield group
                group, room = [], CHUNK_CHARS
    yield group


def tokenized(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_tokens, ids array<int>, round_trip (decoding gives the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        pieces = Pieces(bpe)

        def rows(part: pa.RecordBatch, ids: dict[int, array], start: int) -> pa.RecordBatch:
            own = [ids.get(start + i, array("i")) for i in range(len(part))]
            same = [bpe.decode(x) == (text.as_py() or "").encode() for x, text in zip(own, part.column("text"), strict=True)]
            sizes = np.array([0, *map(len, own)], np.int32)
            flat = pa.array(np.concatenate([np.frombuffer(x, np.int32) for x in own]) if sizes.sum() else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), flat)
            return pa.record_batch({"doc_id": part.column("doc_id"), "n_tokens": pa.array(sizes[1:].astype(np.int64)), "ids": lists, "round_trip": pa.array(same, pa.bool_())})

        for batch in batches:
            ids: dict[int, array] = {}
            done = 0
            for group in matches((x.as_py() for x in batch.column("text")), pattern):
                known = pieces.of([part for _, part in group])
                for row, part in group:
                    ids.setdefault(row, array("i")).extend(chain.from_iterable(map(known.__getitem__, part)))
                # The last text of a group may go on in the next one.
                upto = group[-1][0] if group else len(batch)
                if upto > done:
                    yield rows(batch.slice(done, upto - done), ids, done)
                    ids = {row: x for row, x in ids.items() if row >= upto}
                    done = upto
            if done < len(batch):
                yield rows(batch.slice(done), ids, done)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").transform(textkit.mapped, run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """Every row of ``tokens`` (doc_id, ids array<int>): doc_id, data binary; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            data = [bpe.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "data": pa.array(data, pa.binary())})

    return tokens.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "ids").transform(textkit.mapped, run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; ids never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        name = {v: str(v).encode() for v in bpe.bytes}
        pieces = Pieces(bpe, lambda ids: (b" ".join(map(name.__getitem__, ids)), bpe.decode(ids)))
        for batch in batches:
            count, ids_sha, decoded_sha = np.zeros(len(batch), np.int64), [hashlib.sha256() for _ in range(len(batch))], [hashlib.sha256() for _ in range(len(batch))]
            for group in matches((x.as_py() for x in batch.column("text")), pattern):
                known = pieces.of([part for _, part in group])
                for row, part in group:
                    if part:
                        made = list(map(known.__getitem__, part))
                        ids = b" ".join([x for x, _ in made])
                        ids_sha[row].update(b" " + ids if count[row] else ids)
                        decoded_sha[row].update(b"".join([x for _, x in made]))
                        count[row] += ids.count(b" ") + 1
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(count), "ids_sha256": pa.array([x.hexdigest() for x in ids_sha], pa.string()), "decoded_sha256": pa.array([x.hexdigest() for x in decoded_sha], pa.string())})

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").transform(textkit.mapped, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public 50k vocabulary."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


QUERIES = {"op8_bpe_prefix": op8_bpe_prefix}
ORACLES: dict[str, str] = {}
