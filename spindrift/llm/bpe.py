"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Adjacent parts that form a token wait in the bucket of that token's rank, by the position of their left
part in a linked list. A bitmap of three levels shows which buckets hold anything; find-first-set leads to
the lowest rank. A merge changes two neighbouring pairs; entries that no longer hold are skipped when they
come up. The cost of a pre-token is near-linear in its length, however long it is.

Pre-tokens don't touch each other, so those that a batch of texts has for the first time stand in one list,
end to end, and share the queue: each is merged in the order that it would be merged in alone.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, texts_of

#: Pre-tokens up to this many bytes are remembered, twice so many of them at most in a worker.
REMEMBER_BYTES, REMEMBER = 48, 500_000
#: Bytes of pre-tokens that are merged together (a longer one is merged alone).
MERGE_AT_ONCE = 1 << 13
#: Characters of the texts that are split together (a longer one is split alone).
SPLIT_AT_ONCE = 1 << 20
BIT = [1 << k for k in range(64)]
#: Stands for the rank of two parts that aren't a token.
NONE = 1 << 40


class Codec:
    """Encodes pre-tokens by a table of ranks, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = REMEMBER):
        self.remember = remember
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.low = [0] * ((max(ranks.values()) >> 6) + 1)  # a bit for each rank
        self.mid = [0] * ((len(self.low) >> 6) + 1)  # a bit for each word of them; the top level is one number
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        self.double = np.full(1 << 16, NONE, np.int64)  # ranks of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank
        # of known pre-tokens: their ids as text, the bytes that they decode to, and the ids; with the generation before
        self.known: tuple[dict[str, str], dict[str, bytes], dict[str, tuple[int, ...]]] = ({}, {}, {})
        self.older = ({}, {}, {})

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token, none of which is empty.

        Only pairs whose rank is below that of their neighbours (or equal to the right one's) wait in the
        queue: no other can be next. A merge may make its own new pairs such, or those beyond them.
        """
        get, text, none = self.ranks.get, b"".join(pieces), NONE
        n, ends = len(text), np.cumsum([len(p) for p in pieces])
        raw = np.frombuffer(text, np.uint8).astype(np.int64)
        low, mid, top, bit = self.low, self.mid, 0, BIT  # all zero between calls: every entry is taken out
        after, before = list(range(1, n + 1)), np.arange(-1, n - 1)  # a part is [i, after[i])
        before[ends[:-1]] = -1
        before = before.tolist()
        stop = np.repeat(ends, np.diff(ends, prepend=0)).tolist()  # where the pre-token of each byte ends
        first = np.append(self.double[raw[:-1] << 8 | raw[1:]], none)
        first[ends - 1] = none
        token, pair = self.single[raw].tolist(), first.tolist()  # of the part at i; of it and the next one
        bucket: dict[int, list[int]] = {}
        mixed: set[int] = set()  # ranks whose bucket has lost its order, last places first
        at = np.flatnonzero((first < np.append(none, first[:-1])) & (first <= np.append(first[1:], none)) & (first < none))
        for r, i in zip(first[at[::-1]].tolist(), at[::-1].tolist(), strict=True):
            if r in bucket:
                bucket[r].append(i)
            else:
                bucket[r] = [i]
                w = r >> 6
                low[w] |= bit[r & 63]
                mid[w >> 6] |= bit[w & 63]
                top |= 1 << (w >> 6)
        while top:
            # find-first-set on each level leads to the lowest rank that has a bucket
            x = (top & -top).bit_length() - 1
            m = mid[x]
            w = x << 6 | (m & -m).bit_length() - 1
            word = low[w]
            rank = w << 6 | (word & -word).bit_length() - 1
            waiting = bucket[rank]
            if rank in mixed:  # the leftmost place is taken first
                waiting.sort(reverse=True)
                mixed.remove(rank)
            while waiting:
                i = waiting.pop()
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[gone]
                after[i] = end
                token[i], token[gone] = rank, -1
                was, pair[gone] = pair[gone], none
                fresh = []
                right = ahead = none
                if end < stop[i]:
                    before[end] = i
                    ahead = pair[end]
                    right = get(text[i : after[end]], none)
                    if was <= ahead and ahead < right and ahead <= (pair[after[end]] if after[end] < n else none):
                        fresh.append((ahead, end))
                pair[i] = right
                left = before[i]
                if left >= 0:
                    was, pair[left] = pair[left], (here := get(text[left:end], none))
                    far = before[left]
                    behind = pair[far] if far >= 0 else none
                    if here < behind and here <= right:
                        fresh.append((here, left))
                    if right < here and right <= ahead:
                        fresh.append((right, i))
                    if was < behind and behind <= here and behind < none and behind < (pair[before[far]] if before[far] >= 0 else none):
                        fresh.append((behind, far))
                elif right < none and right <= ahead:
                    fresh.append((right, i))
                lower = False
                for r, place in fresh:
                    lower |= r < rank
                    if r in bucket:
                        bucket[r].append(place)
                        mixed.add(r)
                    else:
                        bucket[r] = [place]
                        v = r >> 6
                        low[v] |= bit[r & 63]
                        mid[v >> 6] |= bit[v & 63]
                        top |= 1 << (v >> 6)
                if lower:
                    break  # a lower rank has come up
            if not waiting:
                del bucket[rank]
                mixed.discard(rank)
                low[w] &= ~bit[rank & 63]
                if not low[w]:
                    mid[x] &= ~bit[w & 63]
                    if not mid[x]:
                        top &= ~(1 << x)
        tokens = np.array(token, np.int64)
        parts = np.flatnonzero(tokens >= 0)
        counts = np.searchsorted(parts, ends)
        ids = tokens[parts].tolist()
        return [ids[a:b] for a, b in zip([0, *counts[:-1].tolist()], counts.tolist(), strict=True)]

    def learn(self, pieces: list[str]) -> None:
        """Make pre-tokens known."""
        raw = [p.encode() for p in pieces]
        todo, found = [], {}
        for k, piece in enumerate(raw):
            if (whole := self.ranks.get(piece)) is not None:
                found[k] = [whole]
            else:
                todo.append(k)
        group, held = [], 0
        for k in [*todo, None]:
            if group and (k is None or held + len(raw[k]) > MERGE_AT_ONCE):
                found |= zip(group, self.merge([raw[g] for g in group]), strict=True)
                group, held = [], 0
            if k is not None:
                group.append(k)
                held += len(raw[k])
        said, decoded, ids_of = self.known
        for k, piece in enumerate(pieces):
            ids_of[piece] = ids = tuple(found[k])
            said[piece] = " ".join(map(str, ids))
            decoded[piece] = self.decode(ids)

    def encode_all(self, texts: list[str]) -> Iterator[tuple[str, bytes, list[str]]]:
        """For each text its ids joined by a space, the bytes that they decode to, and its pre-tokens. Pre-tokens
        take several times the room of their text, so only so many texts are split at once."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > SPLIT_AT_ONCE:
                yield from self._encode(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[tuple[str, bytes, list[str]]]:
        parts = [self.split(t) for t in texts]
        if len(self.known[0]) > self.remember:
            self.known, self.older = ({}, {}, {}), self.known
        new = set().union(*parts).difference(self.known[0])
        for piece in new.intersection(self.older[0]):
            for now, before in zip(self.known, self.older, strict=True):
                now[piece] = before[piece]
        new.difference_update(self.known[0])
        self.learn(list(new))
        said, decoded = self.known[0].__getitem__, self.known[1].__getitem__
        for pieces in parts:
            yield " ".join(map(said, pieces)), b"".join(map(decoded, pieces)), pieces
        for piece in new:
            if len(piece) > REMEMBER_BYTES:
                for table in self.known:
                    del table[piece]

    def ids(self, pieces: list[str]) -> list[int]:
        """The ids of pre-tokens of the texts that are being encoded."""
        return list(chain.from_iterable(map(self.known[2].__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def _codec(ranks: bytes, pattern: str, remember: int = REMEMBER) -> Codec:
    """The ranks file's codec, made once in each worker."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return Codec(table, pattern, remember)


def read_ranks(path: str) -> bytes:
    """The content of a ranks file on the driver: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: bytes, pattern: str, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_ids: bool = True, remember: int = REMEMBER) -> DataFrame:
    """docs' ids: the columns to keep, ids (array of int), n_tokens, ids_sha256 (of the decimal ids joined
    by a space), decoded_sha256 (of the bytes that the ids decode to).

    Each match of `pattern` is encoded by itself; there are no special tokens. A null or empty text has
    no ids. Rows are independent, so ties and repeated rows need no rule; other columns are ignored.
    The ranks go to the executors once, as a broadcast of the file's fixed size. A worker remembers twice
    `remember` pre-tokens at most: fewer take less memory and more time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(ranks)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    made = [("ids", T.ArrayType(T.IntegerType(), False))] * with_ids + [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(name, kind) for name, kind in made)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, pattern, remember)
        for batch in it:
            lists, counts, sums, decoded = [], [], [], []
            gc.disable()  # what is kept holds no cycles, and looking for some takes a fifth of the time
            for said, raw, pieces in codec.encode_all(texts_of(batch, "__text")):
                if with_ids:
                    lists.append(pa.array(codec.ids(pieces), pa.int32()))
                counts.append(said.count(" ") + 1 if said else 0)
                sums.append(hashlib.sha256(said.encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
            gc.enable()
            whole = []
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                whole = [pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(lists) if lists else pa.array([], pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), *whole, pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())],
                names=[f.name for f in schema],
            )

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of encoded rows: id_col, text. Null or no ids give an empty text; bytes that aren't
    UTF-8 come back as the replacement character."""
    spark: SparkSession = encoded.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(ranks)
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, pattern)
        for batch in it:
            texts = [codec.decode(ids or []).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
