"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded; gated attention,
learned from the labels, weighs the passages; the weighted sum of their codes is scored by a logistic
layer. Features of a passage are frequencies of its bytes and of pairs of byte classes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_runs, pieces, small_batches

#: Bytes of a passage; dimensions of its code and of the attention.
PASSAGE, CODE, ATTENTION = 512, 16, 8
#: The model is fitted on at most so many documents of each label, those with the smallest hash of their
#: id, and on no further one once they have so many passages. A document that is taken is taken whole, and
#: of more than so many bytes none is, as its features come to the driver. These bounds are for training
#: alone.
FIT_DOCS, FIT_PASSAGES, FIT_BYTES = 600, 20_000, 1 << 20
#: A document is kept from this score on.
ACCEPT = 0.3


def _classes() -> np.ndarray:
    """Byte classes: each kind of character apart, so that pairs of them tell words, shouting, tables,
    markup and noise from each other."""
    c = np.full(256, 15, np.int64)
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1] = 0, 1, 2
    c[128:192], c[192:] = 3, 4
    for k, chars in enumerate((b" ", b"\n\r\t", b".", b",;:", b"!?", b"#$%&*@", b"|/\\", b"<>{}[]()", b"-_=+~", b"'\"`"), start=5):
        c[list(chars)] = k
    return c


CLASS = _classes()
FEATURES = 256 + 256 + 4


def passages(raw: np.ndarray, starts: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features (n, FEATURES) of all passages of texts, and where each text's passages begin. A text
    without bytes is one passage of zeros."""
    sizes = np.diff(starts)
    per = np.maximum(-(-sizes // size), 1)
    begin = np.concatenate([[0], np.cumsum(per)])
    n = int(begin[-1])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(raw)) - starts[doc]
    of = begin[doc] + at // size
    counts = np.bincount(of * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float32)
    kinds = CLASS[raw]
    near = of[1:] == of[:-1]
    pair = np.bincount((of[1:] * 256 + kinds[:-1] * 16 + kinds[1:])[near], minlength=n * 256).reshape(n, 256).astype(np.float32)
    length = np.maximum(counts.sum(1, keepdims=True), 1)
    by_kind = np.zeros((n, 16), np.float32)
    for k in range(16):
        by_kind[:, k] = counts[:, CLASS == k].sum(1)
    letters = np.maximum(by_kind[:, 0] + by_kind[:, 1] + by_kind[:, 4], 1)
    shape = np.stack(
        [by_kind[:, 1] / letters, by_kind[:, 5] / length[:, 0], letters / length[:, 0], (counts > 0).sum(1) / 64.0], 1
    ).astype(np.float32)
    return np.concatenate([np.sqrt(counts / length), np.sqrt(pair / length), shape], 1), begin


@dataclass
class Mil:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    gate_v: np.ndarray
    gate_u: np.ndarray
    gate_w: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict:
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ self.encode + self.encode_bias)
        t, s = np.tanh(h @ self.gate_v), 1 / (1 + np.exp(-(h @ self.gate_u)))
        a = (t * s) @ self.gate_w
        owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        w = np.exp(a - np.maximum.reduceat(a, begin[:-1])[owner])
        w /= np.add.reduceat(w, begin[:-1])[owner]
        z = np.add.reduceat(h * w[:, None], begin[:-1])
        return {"x": x, "h": h, "t": t, "s": s, "w": w, "z": z, "owner": owner, "p": 1 / (1 + np.exp(-(z @ self.out + self.bias[0])))}


    def chances(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """forward()'s p for texts that stand end to end, worked out piece by piece: of a text's passages so far
        the largest attention, the sum of their weights and that of their weighted codes are carried on."""
        n = len(starts) - 1
        top, total, code = np.full(n, -np.inf), np.zeros(n), np.zeros((n, CODE))
        for lo, hi, parts, of in pieces(starts, PASSAGE):
            x, begin = passages(raw[lo:hi], parts)
            h = np.tanh((x - self.mean) * self.scale @ self.encode + self.encode_bias)
            a = (np.tanh(h @ self.gate_v) / (1 + np.exp(-(h @ self.gate_u)))) @ self.gate_w
            now = np.maximum(top[of], np.maximum.reduceat(a, begin[:-1]))
            w = np.exp(a - np.repeat(now, np.diff(begin)))
            before = np.exp(top[of] - now)
            total[of] = total[of] * before + np.add.reduceat(w, begin[:-1])
            code[of] = code[of] * before[:, None] + np.add.reduceat(h * w[:, None], begin[:-1])
            top[of] = now
        return 1 / (1 + np.exp(-(code / total[:, None] @ self.out + self.bias[0])))


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, *, seed: int = 5, epochs: int = 30, rate: float = 0.01, batch: int = 64, decay: float = 1e-3) -> Mil:
    """A model of bags (passages of document i: x[begin[i]:begin[i + 1]]) with labels y, by Adam on the
    log-loss. Each label has half of the weight, shifted so that a score is a chance at the labels' own
    frequency."""
    rng = np.random.default_rng(seed)
    scale = 1 / (x.std(0) + 0.02) if len(x) else np.ones(FEATURES, np.float32)
    m = Mil(
        x.mean(0) if len(x) else np.zeros(FEATURES, np.float32), scale.astype(np.float32),
        rng.normal(0, 0.5 / np.sqrt(FEATURES), (FEATURES, CODE)).astype(np.float32), np.zeros(CODE, np.float32),
        rng.normal(0, 0.3, (CODE, ATTENTION)).astype(np.float32), rng.normal(0, 0.3, (CODE, ATTENTION)).astype(np.float32),
        rng.normal(0, 0.3, ATTENTION).astype(np.float32), rng.normal(0, 0.3, CODE).astype(np.float32), np.zeros(1, np.float32),
    )
    if not len(y) or y.min() == y.max():
        m.out[:] = 0
        m.bias[:] = 2.0 if not len(y) or y.min() == 1 else -2.0
        return m
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    names = ["encode", "encode_bias", "gate_v", "gate_u", "gate_w", "out", "bias"]
    slow, fast = ({k: np.zeros_like(getattr(m, k)) for k in names} for _ in range(2))
    step, total = 0, epochs * (-(-len(y) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            step += 1
            docs = order[i : i + batch]
            rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            part = np.concatenate([[0], np.cumsum([begin[d + 1] - begin[d] for d in docs])])
            f = m.forward(x[rows], part)
            h, t, s, w, owner = f["h"], f["t"], f["s"], f["w"], f["owner"]
            d_logit = (f["p"] - y[docs]) * weight[docs] / len(docs)
            d_z = d_logit[:, None] * m.out
            d_h = w[:, None] * d_z[owner]
            d_w = (h * d_z[owner]).sum(1)
            d_a = w * (d_w - np.add.reduceat(w * d_w, part[:-1])[owner])
            d_t, d_s = d_a[:, None] * s * m.gate_w * (1 - t * t), d_a[:, None] * t * m.gate_w * s * (1 - s)
            d_h = (d_h + d_t @ m.gate_v.T + d_s @ m.gate_u.T) * (1 - h * h)
            grads = {
                "encode": f["x"].T @ d_h + decay * m.encode, "encode_bias": d_h.sum(0), "gate_v": h.T @ d_t, "gate_u": h.T @ d_s,
                "gate_w": ((t * s) * d_a[:, None]).sum(0), "out": f["z"].T @ d_logit + decay * m.out, "bias": np.array([d_logit.sum()]),
            }
            pace = rate * (1 - step / (total + 1))
            for k in names:
                slow[k] += 0.1 * (grads[k] - slow[k])
                fast[k] += 0.01 * (grads[k] ** 2 - fast[k])
                getattr(m, k)[...] -= pace * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.99**step)) + 1e-7)
    return m


def fit_on(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", most: int = FIT_DOCS, most_passages: int = FIT_PASSAGES) -> Mil:
    """fit() on rows with a label of 0 or 1: at most `most` of each, those with the smallest hash of their
    id, and none after those that have `most_passages` together. All passages of a chosen row count; they
    are encoded in tasks, and only their features come here. The offset is moved by the labels' true
    frequency. Without labels every text gets the same score, above ACCEPT; with one label alone, that
    label's side of it."""
    small_batches(labelled.sparkSession)
    short = F.coalesce(F.octet_length(text_col), F.lit(0)) <= FIT_BYTES
    rows = labelled.filter(F.col(label_col).isin(0, 1) & short).select(
        F.col(label_col).cast("int").alias("label"), F.col(id_col).alias("id"), F.xxhash64(id_col, F.lit("fit")).alias("h"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    x, sizes, y = [np.zeros((0, FEATURES), np.float32)], [], []
    for k in sorted(n):
        # ids first: a text is only moved if its row can be among the chosen ones
        of = rows.filter(F.col("label") == k)
        ids = {r["id"] for r in of.select("h", "id").orderBy("h").limit(most).collect()}
        of = of.filter(F.col("id").isin(ids - {None}) | (F.col("id").isNull() if None in ids else F.lit(False)))
        of = of.select("h", F.xxhash64("text").alias("t"), F.octet_length("text").alias("bytes"), "text")
        taken, total = [], 0
        for r in of.select("h", "t", "bytes").orderBy("h", "t").limit(most).collect():
            if total >= most_passages:
                break
            taken.append((r["h"], r["t"]))
            total += max(-(-r["bytes"] // PASSAGE), 1)
        chosen = of.filter(F.col("h").isin({h for h, _ in taken}) & F.col("t").isin({t for _, t in taken})).dropDuplicates(["h", "t"])
        found = {(r["h"], r["t"]): np.frombuffer(r["features"], np.float16).reshape(-1, FEATURES) for r in chosen.select("h", "t", "text").mapInArrow(_encode, "h long, t long, features binary").collect()}
        for key in taken:
            x.append(found[key].astype(np.float32))
            sizes.append(len(found[key]))
            y.append(k)
    model = fit(np.concatenate(x), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(y, np.int64))
    if len(n) == 2:
        model.bias += np.float32(np.log(n[1] / n[0]))
    return model


def _encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of all passages of each text, as half floats in one run."""
    for batch in batches(it):
        x, begin = passages(*byte_runs(batch))
        x = x.astype(np.float16)
        features = [x[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary())], names=["h", "t", "features"])


def score(docs: DataFrame, model: Mil, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's quality: id_col and score, the chance of label 1.

    All passages of a text are read. A null or empty text is one passage without characters and gets
    that one's score. Rows are independent; other columns are ignored; an empty table gives no rows.
    """
    return _scored(docs.select(F.col(id_col), F.col(text_col).alias("text")), model, [id_col])


def with_score(docs: DataFrame, model: Mil, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with their score beside all their columns."""
    return _scored(docs, model, docs.columns, text_col, score_col)


def _scored(docs: DataFrame, model: Mil, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(pickle.dumps(model))
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add(score_col, "double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Mil = pickle.loads(shipped.value)
        for batch in it:
            if not batch.num_rows:
                continue
            p = model.chances(*byte_runs(batch, text_col))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(np.clip(p, 0, 1), pa.float64())], names=[*keep, score_col]
            )

    return docs.mapInArrow(run, schema)
