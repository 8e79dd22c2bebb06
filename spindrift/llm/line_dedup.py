"""Line deduplication with two Bloom filters.

A first pass notes the hash of every long enough line of a document in one of two filters: seen once,
or seen in a second document. Filters of partitions are merged by OR, and what two of them have in
common has been seen twice. A second pass tests the lines against the merged filter: only those that it
suspects are shuffled, with their whole keys, to be confirmed and to find the first document of each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches, texts_of

#: Bits of a filter and hashes of a key. The size is fixed, so that the broadcast is bounded; a fuller
#: filter suspects more lines, which costs shuffling but changes no result.
BITS, HASHES = 1 << 26, 4
#: Bits in a block, the part of a filter that is merged at once.
PLACES = 1 << 16
#: A line's key has at least this many code points.
LEAST = 10
SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str) -> list[bytes]:
    """The keys of all lines of a text: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(SPACE) for line in text.encode().lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def bit_places(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """The places of each key's bits, a row for each key."""
    first = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    step = (first >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + np.arange(hashes, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _note(once: np.ndarray, twice: np.ndarray, bits_set: np.ndarray) -> None:
    """Add one batch's sorted distinct places per document: those already there have been seen twice."""
    places, counts = np.unique(bits_set, return_counts=True)
    again = places[(once[places]) | (counts > 1)]
    twice[again] = True
    once[places] = True


def _filters(docs: DataFrame, bits: int, hashes: int, least: int) -> DataFrame:
    """Each partition's filters, block by block: those that have any bit, compressed."""
    schema = "block int, once binary, twice binary"
    size = PLACES

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in it:
            places = []
            for text in texts_of(batch):
                keys = list({k for k in line_keys(text) if long_enough(k, least)})
                if keys:
                    places.append(np.unique(bit_places(keys, bits, hashes)))
            if places:
                _note(once, twice, np.concatenate(places))
        for block in range(0, bits, size):
            part = once[block : block + size]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block // size], pa.int32()), pa.array([_pack(np.packbits(part))], pa.binary()), pa.array([_pack(np.packbits(twice[block : block + size]))], pa.binary())],
                    names=["block", "once", "twice"],
                )

    return docs.mapInArrow(run, schema)


def _merge_blocks(parts: DataFrame) -> DataFrame:
    """One row for each block: the filters of all partitions. Each row is of fixed size, and a task
    folds them one after the other."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in it:
            for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = _unpack(once), _unpack(twice)
                if block in merged:
                    c, d = merged[block]
                    merged[block] = (a | c, b | d | (a & c))
                else:
                    merged[block] = (a, b)
        for block, (once, twice) in merged.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([_pack(once)], pa.binary()), pa.array([_pack(twice)], pa.binary())], names=["block", "once", "twice"]
            )

    return parts.mapInArrow(run, parts.schema)


def twice_seen(docs: DataFrame, *, bits: int = BITS, hashes: int = HASHES, least: int = LEAST) -> bytes:
    """The packed bits that at least two documents have set; docs has a column text. A filter of fixed
    size is all that comes to the driver."""
    parts = _filters(docs.select("text"), bits, hashes, least)
    # merged within groups of partitions before all of a block meet
    first = _merge_blocks(parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("block", "g").drop("g"))
    merged = _merge_blocks(first.repartition("block")).select("block", "twice")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        part = _unpack(row["twice"])
        out[row["block"] * (PLACES // 8) :][: len(part)] = part
    return out.tobytes()


def repeated_lines(docs: DataFrame, *, bits: int = BITS, hashes: int = HASHES, least: int = LEAST) -> DataFrame:
    """Of docs (id, text): rows (id, key), the lines that a document loses."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(twice_seen(docs, bits=bits, hashes=hashes, least=least))

    def suspect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shipped.value, np.uint8)
        for batch in it:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                keys = list({k for k in line_keys(text) if long_enough(k, least)})
                if not keys:
                    continue
                places = bit_places(keys, bits, hashes)
                hits = ((seen[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)
                hit = [k for k, h in zip(keys, hits.tolist(), strict=True) if h]
                ids += [i] * len(hit)
                found += hit
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["id", "key"])

    suspects = durable(docs.mapInArrow(suspect, "id long, key binary"))
    # how many documents, not rows: a row repeated with its id is one document
    confirmed = suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("last > first").select(F.col("key").alias("k"), "first")
    # read back, the confirmed keys are dealt out anew for the join, and AQE can split a hot line's rows
    confirmed = durable(confirmed)
    return suspects.join(confirmed, F.col("key") == F.col("k")).filter("id > first").select("id", "key")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, hashes: int = HASHES, least: int = LEAST) -> DataFrame:
    """docs' texts without their repeated lines: id_col, text, n_lines (before), n_dropped, text_sha256.

    Texts are split at newlines; a null or empty text is one empty line. A line whose key has at least
    `least` code points and is found in two documents is dropped from all but the one with the smallest
    id, where each of its lines stays. Ids are taken as unique integers: rows that share one are the
    same document and lose the same lines; of rows without an id nothing is dropped and they make no
    line repeated. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lost = repeated_lines(base.filter("id is not null"), bits=bits, hashes=hashes, least=least)
    per_doc = lost.groupBy("id").agg(F.collect_set("key").alias("keys")).withColumnRenamed("id", "lost_id")
    both = base.join(per_doc, F.col("id") == F.col("lost_id"), "left").select("id", "text", "keys")

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, lines, dropped, sums = [], [], [], []
            for text, keys in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                parts = raw.split(b"\n")
                n = len(parts)
                if keys:
                    lose = set(keys)
                    parts = [p for p in parts if p.lower().strip(SPACE) not in lose]
                    raw = b"\n".join(parts)
                texts.append(raw)
                lines.append(n)
                dropped.append(n - len(parts))
                sums.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums)],
                names=[id_col, "text", "n_lines", "n_dropped", "text_sha256"],
            )

    return both.mapInArrow(rewrite, f"`{id_col}` long, text string, n_lines long, n_dropped long, text_sha256 string")
