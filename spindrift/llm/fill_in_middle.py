"""Fill-in-middle transformation by a sparse checkpoint index.

While a text's units are counted, the byte and the code point at which every EVERY-th unit begins are
recorded. A cut is found by a binary search among these checkpoints and a rescan from there, of fewer than
EVERY units. Texts are counted in pieces of bounded size, so beside the text and its output a worker holds
a checkpoint for each EVERY units and one piece's marks.

A unit is a code point, a word with the white space before it, or a line with its end. Which form a text
takes and where it is cut depend on its id and the seed alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_runs, small_batches

#: Units from one checkpoint to the next, and bytes that are marked at once.
EVERY, PIECE = 256, 1 << 17
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
UNITS = ("char", "word", "line")


def _starts(raw: np.ndarray, at: int, end: int, unit: str) -> np.ndarray:
    """Where in raw[at:end] units begin, counted from `at`."""
    piece = raw[at:end]
    if unit == "char":
        return np.flatnonzero((piece & 0xC0) != 0x80)
    before, here = (raw[at - 1 : end - 1], piece) if at else (piece[:-1], piece[1:])
    if unit == "line":
        new = before == 10
    else:
        gap = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
        new = gap(here) & ~gap(before)
    found = np.flatnonzero(new)
    return found if at else np.concatenate([[0], found + 1])


def _points(piece: np.ndarray) -> int:
    return int(np.count_nonzero((piece & 0xC0) != 0x80))


@dataclass
class Checkpoints:
    """The units of one text: how many, and where each `every`-th begins."""

    raw: np.ndarray
    unit: str
    every: int
    n: int
    points: int
    unit_at: np.ndarray
    byte_at: np.ndarray
    point_at: np.ndarray

    def cut(self, k: int) -> tuple[int, int]:
        """The byte and the code point before which k units stand."""
        if k >= self.n:
            return len(self.raw), self.points
        c = int(np.searchsorted(self.unit_at, k, "right")) - 1
        at = int(self.byte_at[c])
        end = int(self.byte_at[c + 1]) if c + 1 < len(self.byte_at) else len(self.raw)
        found = at + int(_starts(self.raw, at, end, self.unit)[k - int(self.unit_at[c])])
        return found, int(self.point_at[c]) + _points(self.raw[at:found])


def checkpoints(raw: np.ndarray, unit: str = "char", every: int = EVERY) -> Checkpoints:
    """Count a text's units and record a checkpoint at every `every`-th."""
    n, points, bytes_, chars = 0, 0, [], []
    for at in range(0, len(raw), PIECE):
        end = min(len(raw), at + PIECE)
        begin = _starts(raw, at, end, unit)
        due = begin[-n % every :: every]
        bytes_.append(due + at)
        first = np.flatnonzero((raw[at:end] & 0xC0) != 0x80)
        chars.append(np.searchsorted(first, due) + points)
        n, points = n + len(begin), points + len(first)
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return Checkpoints(raw, unit, every, n, points, np.arange(0, n, every), join(bytes_), join(chars))


def _checked(markers: tuple[str, str, str]) -> None:
    if len(set(markers)) < 3 or not all(markers) or any(a != b and a in b for a in markers for b in markers):
        raise ValueError("the markers must differ, and none may be empty or stand within another")


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str = "char", plain_from: int = 90, spm_below: int = 20,
    markers: tuple[str, str, str] = MARKERS, every: int = EVERY,
) -> DataFrame:
    """Every row's training text: id_col, n (its units), form, prefix_chars, middle_chars, output.

    h1 to h4 are the first four groups of eight hex digits of the sha256 of `seed:id`. The prefix has the
    smaller of h1 % (n + 1) and h2 % (n + 1) units, prefix and middle together the larger. Form is plain
    if the text is empty, has a marker in it, or h3 % 100 >= plain_from; else spm if h4 % 100 < spm_below,
    else psm. prefix_chars and middle_chars count code points and are null in plain rows.

    A null text is an empty one: plain, with an empty output. A null id counts as an empty string. Rows
    that repeat an id are cut by the same numbers; each is returned. Other columns are ignored. An empty
    table gives no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    _checked(markers)
    spark = docs.sparkSession
    small_batches(spark)
    whole = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    part = lambda k: F.conv(F.substring(whole, 8 * k + 1, 8), 16, 10).cast("long")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[part(k).alias(f"h{k + 1}") for k in range(4)])
    marks = [m.encode() for m in markers]

    def transformed(raw: np.ndarray, h1: int, h2: int, h3: int, h4: int) -> tuple:
        text = raw.tobytes()
        found = checkpoints(raw, unit, every)
        if not text or h3 % 100 >= plain_from or any(m in text for m in marks):
            return found.n, "plain", None, None, text
        (a, a_chars), (b, b_chars) = (found.cut(k) for k in sorted((h1 % (found.n + 1), h2 % (found.n + 1))))
        prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
        spm = h4 % 100 < spm_below
        return found.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, b"".join((suffix, prefix, middle) if spm else (prefix, suffix, middle))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            raw, starts = byte_runs(batch)
            numbers = zip(*[batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)], strict=True)
            made = [transformed(raw[a:b], *h) for a, b, h in zip(starts[:-1].tolist(), starts[1:].tolist(), numbers, strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = given.schema["id"].dataType.simpleString()
    made = given.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output, form, markers: tuple[str, str, str] = MARKERS) -> F.Column:
    """The text that an output was made from. A text that isn't plain has no marker in it, and a marker
    can't begin within one and end within another, so the three parts stand between the markers."""
    _checked(markers)
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    whole = F.concat(F.when(form == "psm", parts[1]).otherwise(parts[2]), parts[3], F.when(form == "psm", parts[2]).otherwise(parts[1]))
    return F.when(form == "plain", output).otherwise(whole)
