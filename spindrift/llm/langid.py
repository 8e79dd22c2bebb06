"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over windows of fixed length; each filter's largest
response in a window goes through a softmax layer. The network is trained in numpy on labelled texts
and applied to all windows of a text; a text's prediction is the mean over its windows, by length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_runs, has_letter, pieces, small_batches

#: Length of a window in bytes, dimensions of a byte's embedding, filter widths and filters of each.
WINDOW, DIMS, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 12
#: The network is fitted on at most so many texts of a language, those with the smallest hash of their
#: id, and on no further one once they have the language's part of so many windows. A text that is taken
#: is taken whole, and of more than so many bytes none is, as what is trained on comes to the driver. These
#: bounds are for training alone.
FIT_TEXTS, FIT_WINDOWS, FIT_BYTES = 400, 40_000, 1 << 20
#: Windows that are evaluated together.
TOGETHER = 256
UNKNOWN = "und"


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # (257, DIMS); 256 stands for no byte
    filters: list[np.ndarray]  # (width * DIMS, FILTERS) each
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Pooled responses of windows (n, WINDOW) of byte numbers, and what training needs of them."""
        e = self.embed[x]
        n, length, dims = e.shape
        out, kept = [], []
        for kernel, bias in zip(self.filters, self.biases, strict=True):
            width = kernel.shape[0] // dims
            # a filter of width w is w products with shifted embeddings
            flat = e.reshape(-1, dims)
            response = (flat @ kernel[:dims]).reshape(n, length, -1)[:, : length - width + 1].copy()
            for k in range(1, width):
                response += (flat @ kernel[k * dims : (k + 1) * dims]).reshape(n, length, -1)[:, k : length - width + 1 + k]
            best = response.argmax(1)
            out.append(np.maximum(np.take_along_axis(response, best[:, None], 1)[:, 0] + bias, 0))
            kept.append(best)
        return np.concatenate(out, 1), [e, kept]

    def quick(self, x: np.ndarray) -> np.ndarray:
        """pooled() without what training needs."""
        e = self.embed[x]
        n, length, dims = e.shape
        out = []
        step = e.strides[1]
        for kernel, bias in zip(self.filters, self.biases, strict=True):
            width = kernel.shape[0] // dims
            view = np.lib.stride_tricks.as_strided(e, (n, length - width + 1, width * dims), (e.strides[0], step, e.strides[2]))
            out.append(np.maximum((view.reshape(-1, width * dims) @ kernel).reshape(n, length - width + 1, -1).max(1) + bias, 0))
        return np.concatenate(out, 1)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.quick(x) @ self.dense + self.offset)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def windows(raw: np.ndarray, starts: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of texts cut to windows: byte numbers (n, length) padded by 256, the text of each window
    and its number of bytes."""
    sizes = np.diff(starts)
    per = -(-sizes // length)
    owner = np.repeat(np.arange(len(sizes)), per)
    first = np.repeat(np.cumsum(per) - per, per)
    begin = starts[owner] + (np.arange(len(owner)) - first) * length
    used = np.minimum(starts[owner + 1] - begin, length)
    at = begin[:, None] + np.arange(length)
    x = np.where(np.arange(length) < used[:, None], raw[np.minimum(at, max(len(raw) - 1, 0))] if len(raw) else 0, 256)
    return x.astype(np.int16), owner, used


def fit(texts: list[str], langs: list[str], **options) -> Net:
    """train() on all windows of labelled texts."""
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
    x, owner, used = windows(raw, starts)
    names = sorted(set(langs))
    return train(x, used, np.array([names.index(k) for k in langs], int)[owner], names, **options)


def train(x: np.ndarray, used: np.ndarray, y: np.ndarray, names: list[str], *, seed: int = 7, steps: int = 350, rate: float = 0.02, batch: int = 96) -> Net:
    """A network trained on windows x of `used` bytes and languages names[y], by Adam with cross-entropy.
    A window weighs by its bytes, as it does in a prediction. Languages are drawn alike, each one's windows
    in turn in random orders; there are `steps` steps, and more if it takes more to use every window."""
    rng = np.random.default_rng(seed)
    net = Net(
        names,
        rng.normal(0, 0.5, (257, DIMS)).astype(np.float32),
        [rng.normal(0, 0.4, (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    if len(names) < 2 or not len(x):
        return net
    params = [net.embed, *net.filters, *net.biases, net.dense, net.offset]
    slow, fast = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_lang = [np.flatnonzero(y == k) for k in range(len(names))]
    by_lang = [rows for rows in by_lang if len(rows)]
    each = batch // len(by_lang) + 1
    steps = max(steps, *(-(-len(rows) // each) for rows in by_lang))
    turns = [np.concatenate([rng.permutation(rows) for _ in range(-(-steps * each // len(rows)))]) for rows in by_lang]
    for step in range(1, steps + 1):
        rows = np.concatenate([turn[(step - 1) * each : step * each] for turn in turns])
        xb, yb = x[rows], y[rows]
        pooled, (e, best) = net.pooled(xb)
        p = softmax(pooled @ net.dense + net.offset)
        d = p
        d[np.arange(len(yb)), yb] -= 1
        d *= (used[rows] / used[rows].sum())[:, None]
        grads = {id(net.dense): pooled.T @ d, id(net.offset): d.sum(0)}
        back = (d @ net.dense.T) * (pooled > 0)
        g_embed = np.zeros_like(net.embed)
        for k, (kernel, bias, where) in enumerate(zip(net.filters, net.biases, best, strict=True)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[id(bias)] = g.sum(0)
            g_kernel = np.zeros_like(kernel)
            for o in range(kernel.shape[0] // DIMS):
                at = where + o  # (n, FILTERS): the byte below each filter's offset
                seen = np.take_along_axis(e, at[:, :, None], 1)
                g_kernel[o * DIMS : (o + 1) * DIMS] = np.einsum("nfd,nf->df", seen, g)
                np.add.at(g_embed, np.take_along_axis(xb, at, 1), g[:, :, None] * kernel[o * DIMS : (o + 1) * DIMS].T[None])
            grads[id(kernel)] = g_kernel
        grads[id(net.embed)] = g_embed
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p_, m, v in zip(params, slow, fast, strict=True):
            g = grads[id(p_)]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def fit_on(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = FIT_TEXTS, most_windows: int = FIT_WINDOWS) -> Net:
    """train() on the rows that have a language: at most `most` of each, those with the smallest hash of
    their id, and none after those that have the language's part of `most_windows`. All windows of a
    chosen row count; they are cut in tasks and come here as they are trained on."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.octet_length(text_col).between(1, FIT_BYTES)).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col, F.lit("fit")).alias("h"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")
    )
    lists = _smallest(rows, most)
    taken = []
    for lang, xs in sorted(lists.items()):
        total = 0
        for r in xs:
            if total >= most_windows / len(lists):
                break
            taken.append((lang, r["h"], r["t"]))
            total += -(-r["bytes"] // WINDOW)
    names = sorted({lang for lang, _, _ in taken})
    if not taken:
        return train(np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64), np.zeros(0, int), names)
    chosen = rows.filter(F.col("h").isin({h for _, h, _ in taken}) & F.col("t").isin({t for _, _, t in taken})).dropDuplicates(["lang", "h", "t"])
    found: dict[tuple, list] = {}
    for r in chosen.mapInArrow(_cut, "lang string, h long, t long, place long, used long, bytes binary").collect():
        found.setdefault((r["lang"], r["h"], r["t"]), []).append((r["place"], r["used"], r["bytes"]))
    of = [(names.index(key[0]), used, data) for key in taken for _, used, data in sorted(found[key])]
    used = np.array([u for _, u, _ in of])
    x = np.frombuffer(b"".join(data for _, _, data in of), np.uint8).reshape(-1, WINDOW).astype(np.int16)
    x[np.arange(WINDOW) >= used[:, None]] = 256
    return train(x, used, np.array([k for k, _, _ in of]), names)


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each text, in a row each."""
    for batch in batches(it):
        x, owner, used = windows(*byte_runs(batch))
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        data = pa.array([w.tobytes() for w in x.astype(np.uint8)], pa.binary())
        keys = [batch.column(k).take(pa.array(owner)) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(place, pa.int64()), pa.array(used, pa.int64()), data], names=["lang", "h", "t", "place", "used", "bytes"])


def _smallest(rows: DataFrame, most: int) -> dict[str, list]:
    """Hashes and bytes of the `most` rows of each language with the smallest hash, in order. The hash cuts
    all but about twice as many away before any row is moved, so no language's rows meet in one task. There
    is a count for each language, that is, for each class of the network."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (2.0 * most + 64.0) / n))])
    near = rows.filter((F.col("h") / float(1 << 63) + 1) / 2 <= F.element_at(share, F.col("lang")))
    item = F.struct("h", "t", F.octet_length("text").alias("bytes"))
    few = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(item)), 1, most).alias("xs"))
    return {r["lang"]: r["xs"] for r in few.collect()}


def identify(docs: DataFrame, net: Net, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's language: id_col, lang_pred, score (mean chance of that language, 0 to 1).

    All of a text is read, in windows of WINDOW bytes; a window counts by its bytes. A text that is null
    or has no letter gets `und` and score 0, and so does every text if no language was learned. Of equal chances the first language in order wins. Rows
    are independent; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(pickle.dumps(net))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Net = pickle.loads(shipped.value)
        for batch in it:
            if not net.langs:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([UNKNOWN] * batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows))], names=[id_col, "lang_pred", "score"])
                continue
            raw, starts = byte_runs(batch)
            sums = np.zeros((batch.num_rows, len(net.langs)))
            for lo, hi, begin, of in pieces(starts, WINDOW):
                x, owner, used = windows(raw[lo:hi], begin)
                for i in range(0, len(x), TOGETHER):
                    p = net.chances(x[i : i + TOGETHER]) * used[i : i + TOGETHER, None]
                    np.add.at(sums, of[owner[i : i + TOGETHER]], p)
            sums /= np.maximum(np.diff(starts), 1)[:, None]
            best = sums.argmax(1)
            lettered = [has_letter(raw[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            lang = [net.langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
            score = [float(min(1.0, s)) if ok else 0.0 for s, ok in zip(sums[np.arange(len(best)), best], lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
