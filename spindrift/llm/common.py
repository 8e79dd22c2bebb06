"""Session, storage and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import codecs
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Arrow batches handed to Python hold at most this many rows and bytes, so that a worker's memory
#: depends on neither the table's size nor its longest runs of long texts.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators that run in this session, and send their code.
    Every operator sets the same bounds, as its result may be read after another one has been built."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def number_batches(spark: SparkSession) -> Iterator[None]:
    """Larger batches for rows of a few numbers, while a table is written; afterwards the former bound."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 16))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode,
    where there is one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder: later steps neither recompute them nor lose them
    with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As durable(), as a Parquet table: smaller for wide rows, and read by column."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/spindrift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(spark: SparkSession, least: int = 1) -> int:
    """How many partitions a shuffle of this session makes."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def thin(df: DataFrame) -> DataFrame:
    """df dealt to an eighth of a shuffle's partitions: for rows of a few numbers, so that a table of them isn't
    written as many files of next to nothing. What makes the rows keeps its width."""
    return df.hint("rebalance", max(4, slices(df.sparkSession) // 8))


def free(name: str, taken) -> str:
    """A column name that isn't taken, in whatever case."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


def crc_fold(doc_id) -> F.Column:
    """crc32 of the id's decimal text modulo 5; 0 marks the held-out fold."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(0)).cast("string").cast("binary")) % 5


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def byte_runs(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the batch's texts, and where each text starts (one entry more than there are
    texts). A null text is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


#: Bytes of texts whose features are worked out at once.
AT_ONCE = 1 << 20


def pieces(starts: np.ndarray, unit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts that stand end to end, in pieces of AT_ONCE bytes at most: (first byte, end, where each part of a
    text begins and the last ends, counted from the first byte, the text of each part). A text that is longer is
    parted at multiples of `unit` bytes; a piece has one part of a text at most."""
    most = max(AT_ONCE // unit, 1) * unit
    begin, of, size = [], [], 0
    for text, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        while True:
            part = min(b - a, most)
            if of and (size + part > most or of[-1] == text):
                yield begin[0], begin[0] + size, np.array([*begin, begin[0] + size]) - begin[0], np.array(of)
                begin, of, size = [], [], 0
            begin.append(a)
            of.append(text)
            size, a = size + part, a + part
            if a >= b:
                break
    if of:
        yield begin[0], begin[0] + size, np.array([*begin, begin[0] + size]) - begin[0], np.array(of)


def has_letter(raw: np.ndarray) -> bool:
    """Whether a text has a letter of any script; it is read in parts, and only until one is found."""
    decoder = codecs.getincrementaldecoder("utf-8")("ignore")
    for at in range(0, len(raw), AT_ONCE):
        part = raw[at : at + AT_ONCE]
        low = part | 32
        if ((low >= 97) & (low <= 122)).any() or any(map(str.isalpha, decoder.decode(part.tobytes()))):
            return True
    return False


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in it if b.num_rows)


#: Multiplier of the byte hash, odd, so that it can be undone modulo 2^64.
STEP = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once (a longer word is hashed whole).
HASH_AT_ONCE = 1 << 19
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse for i < n, modulo 2^64. Tables of the usual size are kept."""
    if _powers and n <= len(_powers[0]):
        return _powers[0][:n], _powers[1][:n]
    size = max(n, HASH_AT_ONCE + 1)
    up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
    up[1:], down[1:] = np.uint64(STEP), np.uint64(pow(STEP, -1, 1 << 64))
    found = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size == HASH_AT_ONCE + 1:
        _powers[:] = found
    return found[0][:n], found[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the result depends on all of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, runs of other bytes than ASCII white space, A-Z lower-cased: each one's hash,
    its text and its first byte. Long texts are hashed in pieces cut at white space."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    cut = np.zeros(n + 1, bool)
    cut[starts] = True  # texts stand end to end
    free = gap | cut[:-1]  # a piece may begin here
    found, at = [], 0
    while at < n:
        end = min(n, at + HASH_AT_ONCE)
        if end < n:
            back = np.flatnonzero(free[at + 1 : end + 1])
            if len(back):
                end = at + 1 + int(back[-1])
            else:
                ahead = int(np.argmax(free[end:]))
                end = end + ahead if free[end + ahead] else n
        found.append(_hashed(raw[at:end], gap[at:end], cut[at : end + 1], at))
        at = end
    hashes, first = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, np.searchsorted(starts, first, "right") - 1, first


def _hashed(raw: np.ndarray, gap: np.ndarray, cut: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a piece that begins at byte `at`: hashes and first bytes."""
    n = len(raw)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    first = np.flatnonzero(~gap & (before | cut[:-1]))
    end = np.flatnonzero(~gap & (after | cut[1:])) + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)), first + at
