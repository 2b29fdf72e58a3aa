"""Toxicity by compression distance under two zstandard dictionaries.

One dictionary is trained on windows of ordinary documents, one on windows of
toxic documents, each on the text as it stands.  A window compresses to fewer
bytes by what the dictionary at hand knows.  Most of a toxic document is
ordinary text, so the toxic dictionary is laid before the ordinary one: the
bytes that a window saves when it is added are the window's distance, and what
both classes share tells nothing.  A document's distances are summed up in a
few numbers that a logistic model turns into a calibrated score.  It is fitted
by two halves: each half's numbers come from dictionaries of the other half, so
no text is measured by what it trained.  The dictionaries for scoring are
trained on both.

A window is ``WINDOW_WORDS`` words with a space on either side, and the next
begins ``STEP_WORDS`` on, so that neighbours share a word.  A run of spaces is added before
compressing: without it zstandard stores short windows as they are and their
lengths say nothing.

Training takes a bounded sample of labelled documents, each of them whole: in
the order of a hash, at most ``PER_CLASS`` of a class and as many of these as
have ``SAMPLE_BYTES`` together; a document longer than that is passed over.  A
doc_id that stands for several texts is sampled with the first of them.  The
held-out fold never takes part.  Scoring reads every text as a whole.

Null and empty texts have no windows and get the score of a document without
any distance.  Null doc_ids are scored and held_out is null.  Repeated rows
stay repeated; other columns are ignored; an empty table gives no rows.
Without labels of both classes the score is the share of toxic labels, 0
without any.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm.sampling import fold, sample
from convolake.storage import keep, table

PER_CLASS = 4000
SAMPLE_BYTES = 8 << 20
WINDOW_WORDS = 3
STEP_WORDS = 2
THRESHOLD = 0.3
ORDINARY_BYTES = 262_144
TOXIC_BYTES = 16_384
#: Lengths that zstandard's dictionary builder selects by and cuts out.
SEGMENT_BYTES, MATCH_BYTES = 48, 8
#: Windows that are compressed at a time, so that a very long text needs no more memory than others.
BATCH = 50_000
_PAD = b" " * 32
_EXCESS = (1, 2, 3, 4)
N_FEATURES = 5 + 2 * len(_EXCESS)


def windows(text: str | None, step: int = STEP_WORDS) -> list[bytes]:
    """A text's windows in lower case; a short text is one, one without words has none."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    last = max(1, len(words) - WINDOW_WORDS + step) if words else 0
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, last, step)]


class Distance:
    """Bytes that windows save by the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self._compressors = [self._compressor(x) for x in (ordinary, toxic + ordinary)]

    @classmethod
    @functools.lru_cache(4)
    def load(cls, ordinary: bytes, toxic: bytes) -> Distance:
        return cls(ordinary, toxic)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        # as plain content: literals cost a byte each, so that words no dictionary knows stand out
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=19, hash_log=18, chain_log=18, search_log=4,
            target_length=16, write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        known.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=params)

    def windows(self, text: str | None) -> np.ndarray:
        """The distance of each window of a text."""
        padded = [w + _PAD for w in windows(text)]
        found = []
        for at in range(0, len(padded), BATCH):
            some = padded[at : at + BATCH]
            plain, both = (c.multi_compress_to_buffer(some) for c in self._compressors)
            found += [len(plain[k]) - len(both[k]) for k in range(len(some))]
        return np.array(found, np.int64)

    def features(self, text: str | None) -> np.ndarray:
        """The largest distances, their mean, the number of windows, and the excess over several limits."""
        d = self.windows(text)
        if not len(d):
            return np.zeros(N_FEATURES)
        top = np.sort(d)[::-1][:4]
        over = [float(np.maximum(d - k, 0).sum()) for k in _EXCESS]
        best = [float(top[0]), float(top[:2].mean()), float(top.mean()), float(d.mean()) * math.sqrt(len(d)), math.log1p(len(d))]
        return np.array([*best, *(math.log1p(x) for x in over), *(x / math.sqrt(len(d)) for x in over)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, of a ridge logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    beta = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - penalty @ beta)
        beta += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-6:
            break
    return beta


def _dictionary(texts: list[str], size: int) -> bytes:
    """What zstandard's builder makes of the texts' windows."""
    samples = [w for text in texts for w in windows(text, WINDOW_WORDS)]
    random.Random(len(samples)).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT_BYTES, d=MATCH_BYTES).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
        return b"".join(dict.fromkeys(samples))[-size:] or b" " * 8


def dictionaries(learn: list[tuple[int, str]]) -> dict[str, bytes]:
    """The ordinary and the toxic dictionary of labelled texts (y, text)."""
    sides = [[text for y, text in learn if y == side] for side in (0, 1)]
    return {"ordinary": _dictionary(sides[0], ORDINARY_BYTES), "toxic": _dictionary(sides[1], TOXIC_BYTES)}


def _within_bounds(picked: DataFrame) -> list[int]:
    """doc_ids of ``picked`` (doc_id, y, u, n_bytes), no more than twice ``PER_CLASS`` rows, whose texts fit in ``SAMPLE_BYTES`` a class."""
    room, taken = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sorted(picked.select("u", "doc_id", "y", "n_bytes").collect()):
        if r["n_bytes"] <= room[r["y"]]:
            room[r["y"]] -= r["n_bytes"]
            taken.append(r["doc_id"])
    return taken


def train(docs: DataFrame, labels: DataFrame, allowed: F.Column, per_class: int = PER_CLASS) -> dict:
    """Dictionaries and coefficients from the labelled rows that ``allowed`` admits."""
    picked, counts = sample(labels, "toxic", allowed, per_class)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return {"share": share}
    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    once = labelled.groupBy("doc_id", "y", "u").agg(F.min("text").alias("text"))
    held = keep(once.withColumn("n_bytes", F.octet_length("text").cast("long")), "labelled")  # at most 2 * per_class documents
    held = held.filter(F.col("doc_id").isin(_within_bounds(held)))
    parity = F.pmod("u", F.lit(2))
    texts = [(r["half"], r["y"], r["text"]) for r in held.select(parity.alias("half"), "y", "text").orderBy("u", "doc_id").collect()]
    rows = []
    for half in (0, 1):
        model = dictionaries([(y, text) for h, y, text in texts if h == half])
        rows += measured(held.filter(parity != half).select("doc_id", "y", "text"), model).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["features"] for r in rows]).reshape(len(rows), -1), np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return {"share": share}
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    scale = np.maximum(x.std(axis=0), 1e-6)
    beta = logistic(x / scale, y, weight)
    return dictionaries([(y, text) for _, y, text in texts]) | {"share": share, "beta": np.append(beta[:-1] / scale, beta[-1])}


def measured(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``features`` in place of ``text``."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = Distance.load(model["ordinary"], model["toxic"])
        for texts in batches:
            yield pd.Series([distance.features(t) for t in texts], dtype=object)

    return docs.withColumn("features", of(F.col("text"))).drop("text")


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` in place of ``text``."""
    if "beta" not in model:
        return docs.withColumn("score", F.lit(float(model["share"]))).drop("text")
    beta = model["beta"].tolist()
    terms = [F.get("features", k) * F.lit(b) for k, b in enumerate(beta[:-1])]
    logit = functools.reduce(lambda a, b: a + b, terms, F.lit(beta[-1]))
    return measured(docs, model).withColumn("score", 1 / (1 + F.exp(-logit))).drop("features")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, fold(4) != 2)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(4) == 2).alias("held_out"), "text"), model)
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
