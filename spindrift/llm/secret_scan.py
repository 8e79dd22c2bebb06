"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

A token that no pattern names is a secret if its characters follow the model of random strings better
than that of identifiers: the log-likelihood ratio per character is above a threshold. Both are trained
on labelled samples, and the model of identifiers also on how characters follow each other in all the
documents' own words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AT_ONCE, byte_runs, small_batches, texts_of

#: Kinds in the order in which those that start together are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the models judge: runs of these of LEAST characters or more; a dot counts if more follows.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.+[A-Za-z0-9+/_=-]+)*")
LEAST = 16
#: The ratio per character, in nats, above which a token counts as random.
THRESHOLD = 0.5
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
INDEX = {c: i + 1 for i, c in enumerate(ALPHABET)}  # 0: the start, and any other character
#: How much the documents' pairs of characters weigh beside those of the sample of identifiers.
DOCUMENTS_WEIGH = 4.0

#: Words of which identifiers are made for the ordinary sample.
WORDS = (
    "account action active address album answer array article author balance batch block border bottom branch buffer build button cache "
    "camera cancel channel chapter client cluster column comment common compare compute config connect console content context control "
    "copy count create cursor customer data database date default delete detail device digest direct display document domain driver "
    "element email enable engine entry error event example expect export extra factory feature field file filter final first folder "
    "font format forward frame function garden general global graph group handle header height history image import index input insert "
    "inside instance internal island item iterator join journal kernel label language layer layout length letter level library limit "
    "list local location login machine manager market master matrix member memory message method model module monitor mother network "
    "number object offset open option order origin output owner packet page panel parent parse partner pattern payment person picture "
    "pixel plugin point policy position prefix previous price print process product profile project property provider public quantity "
    "query queue random range reader record reference region release remote render report request resource response result return river "
    "round route sample schema scope screen script search second section select server service session setting shadow shape signal "
    "simple size source space special stack start state status storage stream string structure student style submit suffix summary "
    "support switch symbol system table target template temporary test text thread time title total track transfer tree trigger type "
    "union unique update upload user value variable vector version video view visible water weather widget width window worker write zone"
).split()


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of character pairs, random over ordinary: [before, after]."""

    ratio: np.ndarray

    def per_char(self, token: str) -> float:
        """The ratio per character. What repeats itself tells nothing new, so a pair of characters counts once."""
        at = [INDEX.get(c, 0) for c in token]
        pairs = set(zip([0, *at[:-1]], at, strict=True))
        return float(sum(self.ratio[a, b] for a, b in pairs)) / len(at) if at else 0.0


def fit(random: list[str], ordinary: list[str], *, smooth: float = 0.5, documents: np.ndarray | None = None) -> Model:
    """The models' ratio, from labelled samples of both kinds; documents: counts of character pairs, as
    document_pairs() gives them, that the ordinary ones weigh with."""

    def counts(tokens: list[str]) -> np.ndarray:
        n = np.zeros((len(ALPHABET) + 1,) * 2)
        for token in tokens:
            at = [INDEX.get(c, 0) for c in token]
            np.add.at(n, ([0, *at[:-1]], at), 1)
        return n

    plain = counts(ordinary)
    if documents is not None and documents.sum():
        plain += documents * (DOCUMENTS_WEIGH * plain.sum() / documents.sum())
    chances = lambda n: np.log((n + smooth) / (n + smooth).sum(1, keepdims=True))
    return Model(chances(counts(random)) - chances(plain))


def document_pairs(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """How often each character of ALPHABET follows each other, or the start of a run of them, in all texts:
    counted in tasks and summed, so that what comes here is the square of the alphabet at most."""
    small_batches(docs.sparkSession)
    size = len(ALPHABET) + 1
    codes = np.zeros(256, np.int64)
    for c, i in INDEX.items():
        codes[ord(c)] = i

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in it:
            raw, starts = byte_runs(batch)
            for at in range(0, len(raw), AT_ONCE):
                end = min(at + AT_ONCE, len(raw))
                here = codes[raw[at:end]]
                before = np.concatenate([codes[raw[at - 1 : at]] if at else [0], here[:-1]])
                before[starts[(starts >= at) & (starts < end)] - at] = 0
                total += np.bincount((before * size + here)[here > 0], minlength=size * size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    out = np.zeros(size * size)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(size, size)


def default_samples(n: int = 4000, seed: int = 11) -> tuple[list[str], list[str]]:
    """Labelled samples made by rule: keys over the usual alphabets, some in dotted parts; and identifiers,
    paths, host names and numbered names made of words, separators and other repeated characters, alphabets,
    dates and numbers."""
    rng = np.random.default_rng(seed)
    alphabets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef"]
    key = lambda i, least: "".join(rng.choice(list(alphabets[i % len(alphabets)]), rng.integers(least, 48)))
    random = [".".join(key(1, LEAST) for _ in range(3)) if i % 16 == 15 else key(i, LEAST) for i in range(n)]
    runs = ALPHABET[:62] + "0123456789" * 2
    ordinary = []
    for i in range(n):
        parts = list(rng.choice(WORDS, rng.integers(2, 6)))
        style = i % 12
        if style == 0:
            name = "_".join(parts)
        elif style == 1:
            name = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 2:
            name = "-".join(parts)
        elif style == 3:
            name = "/".join(parts)
        elif style == 4:
            name = "_".join(parts).upper()
        elif style == 5:
            name = "".join(parts) + str(rng.integers(1, 10_000))
        elif style == 6:
            name = ".".join(parts)
        elif style == 7:  # rules and fillers
            name = "".join(rng.choice(list(ALPHABET[62:] * 4 + "-_=xX0"), rng.integers(1, 3))) * int(rng.integers(LEAST, 60))
        elif style == 8:  # patterns that repeat
            name = "".join(rng.choice(list(ALPHABET), rng.integers(1, 5))) * 20
        elif style == 9:  # alphabets and keyboards' order
            at = int(rng.integers(len(runs)))
            name = (runs[at:] + runs)[: int(rng.integers(LEAST, 60))]
        elif style == 10:  # dates, times and versions
            name = "-".join(f"{x:02}" for x in rng.integers(0, 60, 6)) + "T" + ".".join(map(str, rng.integers(0, 40, 4)))
        else:
            name = "".join(map(str, rng.integers(0, 10, rng.integers(LEAST, 30))))
        ordinary.append(name)
    return random, ordinary


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Places of the fixed patterns, (start, kind's number, end). A match that is too short is dropped,
    but has taken its characters."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def more_spans(text: str, base: list[tuple[int, int, int]], model: Model, threshold: float) -> list[tuple[int, int, int]]:
    """Tokens that look random and overlap no base span."""
    out, i, reach = [], 0, 0  # reach: the furthest end of the base spans that start before the token ends
    for m in TOKEN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach > m.start() or m.end() - m.start() < LEAST:
            continue
        if model.per_char(m[0]) > threshold:
            out.append((m.start(), 3, m.end()))
    return out


def secret_scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Each text's secrets: id_col and spans, an array of (kind, start, end, base) in order of start,
    then of kind; places in code points, end exclusive.

    A null or empty text has none. Rows are independent, so repeated ones need no rule; other columns
    are ignored. Spans of different kinds may share places, those of the models none with the others.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for text in texts_of(batch):
                base = base_spans(text)
                found = sorted(base + more_spans(text, base, model, threshold))
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], names=[id_col, "spans"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    )
