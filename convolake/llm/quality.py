"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words, all of them.  Each
passage is encoded as ``h = tanh(x W + b)`` of its measured features; gated
attention gives it the weight ``softmax(w . (tanh(h V) * sigmoid(h U)))`` among
the document's passages, and the weighted sum of the encodings is what a
logistic output scores.  Labels belong to documents only, so one junk passage
among many good ones can still decide a document.

All weights are learnt by Adam on at most ``PER_CLASS`` labelled documents of
each class, never of the held-out fold; a class counts by its share of all
labels.  Executors measure the passages and score them with the broadcast
model, which is some tens of kilobytes whatever the data.

Features come from one pass over a text's bytes in numpy: shares of letters,
capitals, digits, symbols and marks, distinct and repeated words, and
``HASHED`` buckets of word hashes.  Null and empty texts, and those of white
space alone, are one passage without words.  Null doc_ids are scored and
held_out is null.  Repeated rows stay repeated; other columns are ignored.
Without labels of both classes the score is the share of label 1, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm.sampling import fold, sample
from convolake.storage import table

PER_CLASS = 3000
THRESHOLD = 0.3
PASSAGE_WORDS = 96
HASHED = 32
ENCODING = 16
ATTENTION = 16
EPOCHS = 40
SEED = 7

_SPACE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP, _CALL, _HIGH, _OTHER = range(9)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[128:] = _HIGH
for _kind, _chars in {
    _SPACE: b" \t\n\x0b\f\r",
    _LOWER: bytes(range(97, 123)),
    _UPPER: bytes(range(65, 91)),
    _DIGIT: b"0123456789",
    _SYMBOL: b"#*$%&|<>{}[]\\/=_~^@",
    _STOP: b".,;:",
    _CALL: b"!?",
}.items():
    _KIND[list(_chars)] = _kind
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, np.uint64))
_MEASURED = 18
WIDTH = _MEASURED + HASHED


def passages(text: str | None) -> np.ndarray:
    """One row of features for each passage of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kind = _KIND[raw]
    solid = kind != _SPACE
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    lengths = ends - starts
    spans = np.diff(np.append(starts, len(raw)))  # from each word's start to the next one's
    place = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(raw)) - np.repeat(starts, spans)])
    mixed = (raw.astype(np.uint64) + 1) * _POWERS[place & (len(_POWERS) - 1)] * solid
    hashes = np.add.reduceat(mixed, starts)
    hashes ^= hashes >> np.uint64(29)
    bag = np.arange(n) // PASSAGE_WORDS
    first = starts[::PASSAGE_WORDS]
    bags = len(first)
    words = np.bincount(bag, minlength=bags).astype(np.float64)
    per_kind = [np.add.reduceat((kind == k).astype(np.int32), first) for k in range(9)]
    chars = np.maximum(1, sum(per_kind) - per_kind[_SPACE])
    lines = np.add.reduceat((raw == 10).astype(np.int32), first)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(bag, flags, bags) / words

    upper, symbol = np.add.reduceat((kind == _UPPER).astype(np.int32), starts), np.add.reduceat((kind == _SYMBOL).astype(np.int32), starts)
    call = np.add.reduceat((kind == _CALL).astype(np.int32), starts)
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    order = np.lexsort((hashes, bag))
    fresh = np.ones(n, bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (bag[order][1:] != bag[order][:-1])
    distinct = np.bincount(bag[order], fresh, bags) / words
    out = np.zeros((bags, WIDTH), np.float32)
    columns = [np.log1p(words) / 5, np.minimum(1, words / 10), chars / words / 10, lines / words]
    columns += [per_kind[k] / chars for k in (_LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP, _CALL, _HIGH, _OTHER)]
    columns += [distinct, share(again), share((upper >= 2) & (2 * upper > lengths)), share(symbol > 0), share(call > 0), share(lengths == 1)]
    out[:, :_MEASURED] = np.stack(columns, 1)
    spread = np.bincount(bag * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=bags * HASHED)
    out[:, _MEASURED:] = np.sqrt(spread.reshape(bags, HASHED) / words[:, None])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """The network: weights by name, over standardized features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> None:
        self.mean, self.scale = mean, scale
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {
            "W": init(WIDTH, ENCODING), "b": np.zeros(ENCODING), "V": init(ENCODING, ATTENTION),
            "U": init(ENCODING, ATTENTION), "w": init(ATTENTION), "c": init(ENCODING), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
        """``x`` holds the passages of documents that begin at ``firsts``."""
        p = self.p
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        doc = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, firsts)[doc])
        a = e / np.add.reduceat(e, firsts)[doc]
        m = np.add.reduceat(a[:, None] * h, firsts)
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "m": m, "doc": doc, "s": _sigmoid(m @ p["c"] + p["d"])}

    def gradients(self, x: np.ndarray, firsts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, firsts)
        out = (f["s"] - y) * weight / weight.sum()
        to_m = out[:, None] * p["c"]
        to_h = f["a"][:, None] * to_m[f["doc"]]
        to_a = (f["h"] * to_m[f["doc"]]).sum(1)
        to_e = f["a"] * (to_a - np.add.reduceat(f["a"] * to_a, firsts)[f["doc"]])
        to_t = to_e[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        to_g = to_e[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        to_h = (to_h + to_t @ p["V"].T + to_g @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["z"].T @ to_h, "b": to_h.sum(0), "V": f["h"].T @ to_t, "U": f["h"].T @ to_g,
            "w": (f["t"] * f["g"]).T @ to_e, "c": f["m"].T @ out, "d": out.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
            for batch in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 64)):
                step += 1
                firsts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in batch])[:-1]])
                grads = self.gradients(np.concatenate([bags[i] for i in batch]), firsts, y[batch], weight[batch])
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, allowed: F.Column, per_class: int = PER_CLASS) -> dict:
    """The network fitted on the labelled rows that ``allowed`` admits."""
    picked, counts = sample(labels, "quality", allowed, per_class)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return {"share": share}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(x=[passages(t).tobytes() for t in rows["text"]])[["doc_id", "y", "x"]]

    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = labelled.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one row of each sampled doc_id
    rows = sorted(texts.mapInPandas(measure, "doc_id long, y int, x binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH).astype(np.float64) for r in rows]
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return {"share": share}
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    every = np.concatenate(bags)
    rng = np.random.default_rng(SEED)
    net = Attention(every.mean(0), np.maximum(every.std(0), 1e-2), rng)
    net.fit(bags, y, weight, rng)
    return {"share": share, "net": net}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` in place of ``text``."""
    if "net" not in model:
        return docs.withColumn("score", F.lit(float(model["share"]))).drop("text")
    held = docs.sparkSession.sparkContext.broadcast(model["net"])

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = held.value
        for texts in batches:
            yield pd.Series([float(net.forward(passages(t), np.zeros(1, np.int64))["s"][0]) for t in texts], dtype=float)

    return docs.withColumn("score", of(F.col("text"))).drop("text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, fold(5) != 0)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(5) == 0).alias("held_out"), "text"), model)
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
