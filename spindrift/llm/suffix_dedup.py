"""Repeated substrings removed by longest-previous-factor arrays.

A start whose next `length` bytes occur from an earlier start on too (in an earlier document, or further
ahead in the same one) begins a later copy, and all its `length` bytes go. Whether it does is read from the
longest-previous-factor array: of all suffixes in order, only the nearest one before and the nearest one
after with a smaller position can share most with a suffix among those that start earlier.

One suffix order of a whole corpus would have to shuffle every suffix. Only suffixes that may have an equal
start elsewhere are ordered, in three steps:

1. Among the `length` bytes from a start on, the n-gram with the smallest hash is their anchor. Neighbouring
   starts mostly share it, so texts fall into runs of starts of one anchor, and equal starts have equal
   anchors. What is shuffled is a row of some 25 bytes for each run: hashes of its anchor and of its bytes.
   Runs of one anchor and equal bytes are copies as a whole, all but the first; those alone with their
   anchor have no copy; runs that share an anchor but not all bytes are contested.
2. The bytes of contested runs are brought together by anchor. Their suffixes are sorted to the depth
   `length`, and previous and next smaller positions and the least common prefix up to them give the
   longest previous factors.
3. Each document drops what its later copies cover.

Anchors that too many different runs contest are dealt out by the hash of each start's `length` bytes
instead, in bounded parts like runs; so no task gets a whole hot group. Equal runs are first combined where
they are read. Runs are told apart by hashes of 88 bits or more in all, suffixes by their bytes. No row, run
or start is dropped undecided.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, batches, byte_runs, mixed, slices, small_batches, stored

LENGTH = 100
#: Bytes of an anchor's n-gram, at most.
GRAM = 24
#: Bytes whose runs are found at once, and runs that a task combines before it sends them on.
PIECE, HELD = 1 << 18, 1 << 19
#: Suffixes that are sorted at once, as long as an anchor's aren't parted, and parts of runs for each task.
SORTED, PARTS = 1 << 15, 8
#: Runs that contest an anchor, at most, before they are dealt out by their starts.
CONTEST = 8192
#: So many may contest any anchor, however small a task's share is.
FEW = 16
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_LOW = np.uint64((1 << 40) - 1)
_SPANS = pa.schema([("doc", pa.int64()), ("sign", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64()), ("n", pa.int32())])
_SPANS_DDL = "doc long, sign int, lo int, hi int, key long, n int"


def longest_previous(position: np.ndarray, common: np.ndarray, least: int = 0) -> np.ndarray:
    """For suffixes in order, with their positions and the prefix that each has in common with the one
    before it: how much each shares with any suffix of a smaller position, 0 if that is less than `least`.
    """

    def one_way(position: np.ndarray, common: np.ndarray) -> np.ndarray:
        up, low = np.arange(len(position)) - 1, common.copy()
        low[:1] = 0
        todo = np.arange(len(position))
        while True:
            todo = todo[(up[todo] >= 0) & (low[todo] >= least)]
            todo = todo[position[up[todo]] >= position[todo]]
            if not len(todo):
                return np.where((up >= 0) & (low >= least), low, 0)
            # all between up[x] and x are no smaller than x, so x passes over what up[x] passes over
            over = up[todo]
            above, least_on_way = up[over], np.minimum(low[todo], low[over])
            up[todo], low[todo] = above, least_on_way

    after = np.zeros_like(common)
    after[1:] = common[:0:-1]
    return np.maximum(one_way(position, common), one_way(position[::-1], after)[::-1])


def copies(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes raw[at:], of document and start, share `length` bytes with one that starts earlier."""
    if not len(at):
        return np.zeros(0, bool)
    heads = np.lib.stride_tricks.sliding_window_view(raw, length)[at]
    order = np.argsort(heads.view(f"S{length}").ravel(), kind="stable")
    heads = heads[order]
    differ = heads[1:] != heads[:-1]
    common = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), length)])
    by_place = np.lexsort((start, doc))
    new = np.concatenate([[False], (np.diff(doc[by_place]) != 0) | (np.diff(start[by_place]) != 0)])
    position = np.empty(len(at), np.int64)
    position[by_place] = np.cumsum(new)
    found = np.empty(len(at), bool)
    found[order] = longest_previous(position[order], common, length) >= length
    return found


@dataclass
class Runs:
    """Runs of starts lo..lo+more of one anchor, as columns of equal length."""

    gram: np.ndarray
    mark: np.ndarray
    doc: np.ndarray
    sign: np.ndarray
    lo: np.ndarray
    more: np.ndarray

    #: Bytes of each column that are sent; of gram and mark that is the lower part.
    WIDTHS = (5, 6, 8, 4, 4, 2)
    KINDS = (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.uint16)

    def __len__(self) -> int:
        return len(self.lo)

    def __getitem__(self, which) -> Runs:
        return Runs(*(getattr(self, f.name)[which] for f in fields(self)))

    @classmethod
    def joined(cls, parts: list[Runs]) -> Runs:
        if not parts:
            return cls(*(np.zeros(0, k) for k in cls.KINDS))
        return cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))

    def packed(self) -> bytes:
        """Byte by byte, so that equal upper bytes stand together and compress."""
        columns = (np.ascontiguousarray(getattr(self, f.name), k) for f, k in zip(fields(self), self.KINDS, strict=True))
        return b"".join(c.view(np.uint8).reshape(len(self), -1).T[:w].tobytes() for c, w in zip(columns, self.WIDTHS, strict=True))

    @classmethod
    def unpacked(cls, blob: bytes) -> Runs:
        n, at, found = len(blob) // sum(cls.WIDTHS), 0, []
        for width, kind in zip(cls.WIDTHS, cls.KINDS, strict=True):
            whole = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
            whole[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
            found.append(whole.view(kind).ravel())
            at += n * width
        return cls(*found)

    def settled(self) -> tuple[Runs, Runs, np.ndarray]:
        """The earliest run of each class of equal ones; those that have an earlier one; and for each of the
        former how many classes its anchor has. A row given repeatedly counts once."""
        x = self[np.lexsort((self.sign, self.lo, self.doc, self.mark, self.gram))]
        n = len(x)
        if not n:
            return x, x, np.zeros(0, np.int64)
        other = lambda *columns: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
        gram = other(x.gram)
        new = gram | other(x.mark)
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        later = (x.doc != x.doc[first]) | (x.lo != x.lo[first])
        once = new | other(x.doc, x.lo, x.sign)
        group = np.cumsum(gram) - 1
        classes = np.bincount(group[new])[group]
        keep = once & ~later
        return x[keep], x[once & later], classes[keep]


def _sums(raw: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of raw[a:b] follows as (sums[b] - sums[a]) * down[a]."""
    n = len(raw)
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:], down[1:] = np.uint64(step), np.uint64(pow(step, -1, 1 << 64))
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[:n], out=sums[1:])
    return sums, down


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = width - size
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def found_runs(raw: np.ndarray, starts: np.ndarray, doc: np.ndarray, sign: np.ndarray, length: int) -> Iterator[Runs]:
    """The runs of texts that stand end to end, found piece by piece."""
    gram = min(GRAM, (length + 1) // 2)
    index = np.uint64((1 << PIECE.bit_length()) - 1)
    for at in range(0, max(len(raw) - length + 1, 0), PIECE - length + 1):
        piece = raw[at : at + PIECE]
        if len(piece) < length:
            break
        sums, down = _sums(piece, STEP)
        hashes = mixed((sums[gram:] - sums[:-gram]) * down[: len(piece) - gram + 1])
        least = _least((hashes & ~index) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        anchor = (least & index).astype(np.int64)
        inside = np.ones(len(anchor), bool)  # not: starts from which the next text is reached
        first, last = np.searchsorted(starts, (at + 1, at + len(piece)))
        for end in (starts[first : last] - at).tolist():
            inside[max(end - length + 1, 0) : end] = False
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]]) - 1
        lo, hi = lo[inside[lo]], hi[inside[lo]]
        if not len(lo):
            continue
        end, own = hi + length, anchor[lo]
        mark = mixed((sums[end] - sums[lo]) * down[lo] + ((end - lo) * 65537 + own - lo).astype(np.uint64))
        text = np.searchsorted(starts, lo + at, "right") - 1
        yield Runs(hashes[own], mark, doc[text], sign[text], (lo + at - starts[text]).astype(np.int32), (hi - lo).astype(np.uint16))


def _dealt(x: Runs, parts: int, kind: int) -> pa.RecordBatch:
    """Rows (kind, key, data) of the runs' parts; key: the part."""
    part = ((x.gram >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    x, part = x[order], part[order]
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*cut[1:].tolist(), len(part)]
    data = [x[a:b].packed() for a, b in zip(cut.tolist(), ends, strict=True)]
    return _sent(kind, part[cut], data)


def _sent(kind: int, key, data: list[bytes], doc=None, sign=None, lo=None) -> pa.RecordBatch:
    zero = np.zeros(len(data), np.int64)
    given = [np.full(len(data), kind), key, zero if doc is None else doc, zero if sign is None else sign, zero if lo is None else lo]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(given, kinds, strict=True)), pa.array(data, pa.binary())], names=["kind", "key", "doc", "sign", "lo", "data"])


_SENT = "kind int, key long, doc long, sign int, lo int, data binary"
#: Kinds of rows: parts of runs, parts of runs that are known to be copies, bytes of a contested run.
_RUNS, _KNOWN, _BYTES_OF = 0, 1, 2


def _known(x: Runs, parts: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Runs that are known to be copies, as one row that goes to any task."""
    if len(x):
        zero = np.zeros(len(x), np.uint64)
        yield _sent(_KNOWN, [turn % parts], [Runs(zero, zero, x.doc, x.sign, x.lo, x.more).packed()])


def _spans(x: Runs, key: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.ones(len(x), bool) if key is None else np.zeros(len(x), bool)
    key, n = (np.zeros(len(x), np.int64) if v is None else v for v in (key, n))
    return pa.RecordBatch.from_arrays(
        [pa.array(x.doc, pa.int64()), pa.array(x.sign, pa.int32()), pa.array(x.lo, pa.int32()), pa.array(x.lo + x.more.astype(np.int32), pa.int32()), pa.array(key, pa.int64(), mask=none), pa.array(n.astype(np.int32), pa.int32(), mask=none)],
        schema=_SPANS,
    )


def _survey(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """All runs, combined where they are read and dealt out by anchor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, turn = [], 0, 0

        def sent() -> Iterator[pa.RecordBatch]:
            first, later, _ = Runs.joined(held).settled()
            yield _dealt(first, parts, _RUNS)
            yield from _known(later, parts, turn + int(first.lo[:1].sum()))

        for batch in batches(it):
            raw, starts = byte_runs(batch)
            doc, sign = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("sign").to_numpy(zero_copy_only=False)
            for part in found_runs(raw, starts, doc, sign, length):
                held.append(part)
                count += len(part)
                if count >= HELD:
                    yield from sent()
                    held, count, turn = [], 0, turn + 1
        if count:
            yield from sent()

    return docs.mapInArrow(run, _SENT)


def _sorted_out(rows_: DataFrame, length: int, tasks: int) -> DataFrame:
    """Rows (doc, sign, lo, hi, key, n) of starts that are later copies, key being null; and of contested
    runs, with their anchor's key and how many runs contest it."""

    def of_part(key: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        first, later, classes = Runs.joined([Runs.unpacked(b) for b in blobs]).settled()
        yield _spans(later)
        contested = classes > 1
        own = first[contested]
        if len(own):
            yield _spans(own, (own.gram.astype(np.int64) << 20) | np.int64(key & 0xFFFFF), classes[contested])

    def of_bytes(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, sign, lo, data = zip(*group, strict=True)
        sizes = np.array([len(d) for d in data])
        more = sizes - length
        run = np.repeat(np.arange(len(data)), more + 1)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        at = np.repeat(np.cumsum(sizes) - sizes, more + 1) + offset
        doc, sign, lo = np.array(doc, np.int64), np.array(sign, np.int32), np.array(lo, np.int32)
        later = np.flatnonzero(copies(np.frombuffer(b"".join(data), np.uint8), at, doc[run], lo[run] + offset, length))
        if len(later):
            new = np.concatenate([[True], (np.diff(later) > 1) | (np.diff(run[later]) != 0)])
            begin, end = later[new], later[np.concatenate([new[1:], [True]])]
            own = run[begin]
            zero = np.zeros(len(own), np.uint64)
            yield _spans(Runs(zero, zero, doc[own], sign[own], lo[own] + offset[begin].astype(np.int32), (end - begin).astype(np.uint16)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, was = [], 0, None
        for batch in batches(it):
            kind, key, data = (batch.column(c).to_pylist() for c in ("kind", "key", "data"))
            doc, sign, lo = (batch.column(c).to_pylist() for c in ("doc", "sign", "lo"))
            for k in range(len(data)):
                now = (kind[k], key[k])
                # a part of runs ends with its key; bytes of several anchors are sorted together
                if was is not None and now != was and (was[0] == _RUNS or now[0] != was[0] or held >= SORTED):
                    if group:
                        yield from of_part(was[1], group) if was[0] == _RUNS else of_bytes(group)
                    group, held = [], 0
                was = now
                if now[0] == _KNOWN:
                    yield _spans(Runs.unpacked(data[k]))
                elif now[0] == _RUNS:
                    group.append(data[k])
                else:
                    group.append((doc[k], sign[k], lo[k], data[k]))
                    held += len(data[k]) - length + 1
        if group:
            yield from of_part(was[1], group) if was[0] == _RUNS else of_bytes(group)

    dealt = rows_.repartition(tasks, "kind", "key").sortWithinPartitions("kind", "key")
    return dealt.mapInArrow(run, _SPANS_DDL)


def _contested(texts: DataFrame, length: int, parts: int, most: int) -> DataFrame:
    """The bytes of contested runs, keyed by anchor. Where more than `most` contest an anchor, each start
    becomes a run of its own, dealt out by the hash of its bytes."""

    def starts_of(hot: list[tuple]) -> tuple[Runs, Runs]:
        powers = [np.cumprod(np.full(length, step, np.uint64), dtype=np.uint64) for step in (STEP, 0xD6E8FEB86659FD93)]
        parts_ = []
        for doc, sign, lo, data in hot:
            heads = _BYTES[np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)]
            gram, mark = (mixed((heads * p).sum(1, dtype=np.uint64)) for p in powers)
            n = len(gram)
            parts_.append(Runs(gram, mark, np.full(n, doc, np.int64), np.full(n, sign, np.int32), (lo + np.arange(n)).astype(np.int32), np.zeros(n, np.uint16)))
        return Runs.joined(parts_).settled()[:2]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count, turn = [], 0, 0
        for batch in batches(it):
            raw, starts = byte_runs(batch)
            lists = batch.column("runs")
            doc, sign = batch.column("doc").to_pylist(), batch.column("sign").to_pylist()
            usual = []
            for row in range(batch.num_rows):
                text, own = raw[starts[row] : starts[row + 1]], lists[row].values
                for lo, hi, key, n in zip(*(own.field(f).to_pylist() for f in ("lo", "hi", "key", "n")), strict=True):
                    data = text[lo : hi + length].tobytes()
                    if n <= most:
                        usual.append((key, doc[row], sign[row], lo, data))
                    else:
                        hot.append((doc[row], sign[row], lo, data))
                        count += hi - lo + 1
                        if count >= SORTED:
                            first, later = starts_of(hot)
                            yield _dealt(first, parts, _RUNS)
                            yield from _known(later, parts, turn)
                            hot, count, turn = [], 0, turn + 1
            if usual:
                key, d, s, lo, data = zip(*usual, strict=True)
                yield _sent(_BYTES_OF, key, data, d, s, lo)
        if hot:
            first, later = starts_of(hot)
            yield _dealt(first, parts, _RUNS)
            yield from _known(later, parts, turn)

    return texts.mapInArrow(run, _SENT)


def later_copies(docs: DataFrame, length: int = LENGTH, most: int = CONTEST) -> DataFrame:
    """(doc, sign, lo, hi): starts lo..hi of the rows (doc, sign, text) of which each begins a later copy."""
    spark = docs.sparkSession
    tasks = slices(spark)
    parts = PARTS * tasks
    first = stored(_sorted_out(_survey(docs, length, parts), length, tasks))
    contested = first.filter("key is not null")
    # an anchor whose runs are a good part of a task's share is hot
    most = max(FEW, min(most, contested.count() // (2 * tasks)))
    lists = contested.groupBy("doc", "sign").agg(F.collect_list(F.struct("lo", "hi", "key", "n")).alias("runs"))
    second = _sorted_out(_contested(docs.join(lists, ["doc", "sign"]), length, parts, most), length, tasks)
    return first.filter("key is null").select("doc", "sign", "lo", "hi").unionByName(second.filter("key is null").select("doc", "sign", "lo", "hi"))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = CONTEST) -> DataFrame:
    """Every row without its later copies: id_col, n_bytes, n_removed, spans (of bytes removed, from start to
    end, longest possible and in order), kept (the bytes left; characters may be cut).

    Removed is each byte covered by `length` bytes that also start earlier: in a row of a smaller id, or of
    the same id at an earlier start. They are judged on the texts as given, and don't cross texts. A null
    text is an empty one, with nothing removed; so has a text of fewer bytes. A null id counts as the largest
    possible. Rows that share an id are one document given several times: of their strings that start at
    the same place none is a copy, so each of a row's repetitions has the same result, and all are returned.
    Other columns are ignored. An empty table gives no rows.
    """
    if length < 2 or length > 255 + GRAM:
        raise ValueError(f"length is from 2 to {255 + GRAM} bytes")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.hash(text).alias("sign"), text.alias("text"))
    spans = later_copies(given, length, most).groupBy("doc", "sign").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.hash(text).alias("sign")]
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    joined = docs.select(F.col(id_col).alias("id"), *key, text.alias("text")).join(spans, ["doc", "sign"], "left").select("id", "text", "spans")

    def without(raw: np.ndarray, own) -> tuple[int, list[dict], bytes]:
        if own is None or not len(own):
            return 0, [], raw.tobytes()
        lo, end = (own.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "hi"))
        order = np.argsort(lo, kind="stable")
        lo, end = lo[order], np.maximum.accumulate(end[order] + length)
        new = np.concatenate([[True], lo[1:] > end[:-1]])
        begin, end = lo[new].tolist(), end[np.concatenate([new[1:], [True]])].tolist()
        kept = b"".join(raw[a:b].tobytes() for a, b in zip([0, *end], [*begin, len(raw)], strict=True))
        return len(raw) - len(kept), [{"start": a, "end": b} for a, b in zip(begin, end, strict=True)], kept

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches(it):
            raw, starts = byte_runs(batch)
            removed, found, kept = zip(*(without(raw[a:b], s.values) for a, b, s in zip(starts[:-1].tolist(), starts[1:].tolist(), batch.column("spans"), strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(starts), pa.int64()), pa.array(removed, pa.int64()), pa.array(found, kinds), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "spans", "kept"],
            )

    made = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return made.withColumnRenamed("id", id_col)
