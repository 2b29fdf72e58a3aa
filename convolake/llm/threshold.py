"""Exact top-k inner products by the threshold algorithm over sorted lists.

The vectors lie in blocks of at most ``BLOCK_ROWS`` rows.  Each block holds,
for every dimension, its rows in ascending order of that component: the
sorted lists.  A query reads the list of a dimension from the end where its
own weight makes scores high, all dimensions to the same depth; rows seen for
the first time are scored whole, and what an unseen row can score at most is
the sum of the products at that depth.  Once the k-th best score is above that
bound the block is done.  The depth doubles from one round to the next.

Every block meets every query in groups of at most ``GROUP_ROWS``, so nothing
holds more than one block and one group, and neither side is broadcast.  Blocks
are laid out in lanes, and each lane meets a share of the groups, so there is
work for all executors where blocks are few.  The best k of every block are
then ranked for each query.

Products are exact.  Rows and queries whose components are so large that a sum
of products may pass 2**52 are scored by whole numbers of any size; only such
rows leave the sorted lists.

Vectors that are null, or hold a null, NaN or infinite component, take no
part; neither do rows with a null vec_id.  A shorter vector counts as if its
missing components were zero, as does an empty one.  A repeated vec_id is a
candidate each time it occurs, except for queries with that vec_id; as a query
a repeated vec_id is one query for each distinct vector.  A score among a
query's best that no long can hold, or a component that no double can hold
once scaled, is an error.  Other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.storage import keep, table

BLOCK_ROWS = 8192
GROUP_ROWS = 128
FIRST_DEPTH = 16
SCALE = 256
_EXACT = 1 << 52
_LONGS = (-(1 << 63), (1 << 63) - 1)
_TOO_LARGE = "a component times 256 is beyond the range of a double"


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): components floor(256 x), whole numbers as array<double>, of the rows that take part."""

    def scaled(x: F.Column) -> F.Column:
        y = x.cast("double") * SCALE
        # from 2**52 on a double is a whole number, and floor's long would not hold it
        return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).when(F.abs(y) < math.inf, y).otherwise(F.raise_error(F.lit(_TOO_LARGE)))

    finite = F.forall(F.col(embedding), lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False)))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, scaled).alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed in blocks where they lie: (dims, ids, data), data being the matrix by rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = [], []

        def block() -> pd.DataFrame:
            dims = max(map(len, vectors))
            matrix = np.zeros((len(vectors), dims))
            for row, v in zip(matrix, vectors, strict=True):
                row[: len(v)] = v
            return pd.DataFrame([{"dims": dims, "ids": np.array(ids, "<i8").tobytes(), "data": matrix.tobytes()}])

        for pdf in batches:
            for vec_id, v in zip(pdf["vec_id"], pdf["v"], strict=True):
                ids.append(vec_id)
                vectors.append(v)
                if len(ids) == size:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return rows.mapInPandas(run, "dims int, ids binary, data binary")


def index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The blocks of (vec_id, v) with their sorted lists: (block, dims, ids, data, lists)."""

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i : i + 1].copy()
                matrix = np.frombuffer(row["data"].iloc[0]).reshape(-1, max(1, int(row["dims"].iloc[0])))
                lists = np.argsort(matrix, axis=0, kind="stable").T.astype("<i4")
                yield row.assign(lists=[np.ascontiguousarray(lists).tobytes()])

    blocks = _packed(rows, block_rows).withColumn("block", F.monotonically_increasing_id())
    return blocks.mapInPandas(sort, "dims int, ids binary, data binary, block long, lists binary")


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers of any size for doubles that are whole."""
    return np.array([int(x) for x in values.ravel().tolist()], object).reshape(values.shape)


class Lists:
    """One block: its rows, and for every dimension the rows in ascending order."""

    def __init__(self, dims: int, ids: bytes, data: bytes, lists: bytes) -> None:
        ids, matrix = np.frombuffer(ids, "<i8"), np.frombuffer(data).reshape(-1, max(1, dims))[:, :dims]
        order = np.frombuffer(lists, "<i4").reshape(-1, len(ids))[:dims]
        self.limit = math.isqrt(_EXACT // max(1, dims))
        large = np.abs(matrix).max(axis=1, initial=0) > self.limit
        if large.any():
            place = np.cumsum(~large) - 1
            order = place[order[~large[order]].reshape(len(order), -1)]
        self.ids, self.matrix, self.order = ids[~large], matrix[~large], order
        self.large_ids, self.large = ids[large], _whole(matrix[large])
        self.values = np.take_along_axis(self.matrix.T, self.order, 1)

    def _far(self, query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best of ``rows`` by whole numbers of any size."""
        weights = _whole(query)[: rows.shape[1]]
        scores = rows[:, : len(weights)] @ weights if len(weights) else np.zeros(len(ids), object)
        ranked = sorted((-int(s), i) for s, i in zip(scores, ids.tolist(), strict=True) if i != own)[:k]
        return [(-s, i) for s, i in ranked]

    def best(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best rows but those named ``own``; ties go to the smaller vec_id."""
        if np.abs(query).max(initial=0) > self.limit:
            found = self._far(query, own, _whole(self.matrix), self.ids, k)
        else:
            found = self._near(query, own, k)
        if len(self.large_ids):
            found += self._far(query, own, self.large, self.large_ids, k)
            found = [(-s, i) for s, i in sorted((-s, i) for s, i in found)[:k]]
        return found

    def _near(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best of the rows in the lists, by the threshold algorithm."""
        n = len(self.ids)
        used = np.flatnonzero(query[: len(self.order)])
        weights = query[used]
        up = weights > 0
        order, values = self.order[used], self.values[used]
        seen, done = np.zeros(n, bool), np.zeros(n, bool)
        scores, rows = np.empty(0), np.empty(0, np.int64)
        depth = FIRST_DEPTH
        while True:
            depth = min(depth, n) if len(used) else n
            if depth < n:
                seen[order[~up, :depth]] = True
                seen[order[up, n - depth :]] = True
                fresh = np.flatnonzero(seen & ~done)
                done |= seen
            else:
                fresh = np.flatnonzero(~done)
            fresh = fresh[self.ids[fresh] != own]
            found = self.matrix[fresh][:, used] @ weights if len(used) < self.matrix.shape[1] else self.matrix[fresh] @ weights
            scores, rows = np.concatenate([scores, found]), np.concatenate([rows, fresh])
            if len(scores) > k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= cut
                scores, rows = scores[near], rows[near]
                if depth < n:
                    at = np.where(up, values[:, n - 1 - depth], values[:, depth])
                    if cut > float(at @ weights):
                        break
            if depth >= n:
                break
            depth *= 2
        ranked = sorted(zip((-int(s) for s in scores), self.ids[rows].tolist(), strict=True))[:k]
        return [(-s, vec_id) for s, vec_id in ranked]


def search(blocks: DataFrame, queries: DataFrame, k: int = 5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``blocks`` for each of ``queries`` (vec_id, v)."""
    groups = _packed(queries, group_rows).withColumn("group", F.monotonically_increasing_id())
    places = max(1, blocks.select("block").count())
    parts = max(places, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lanes = math.ceil(2 * parts / places)
    lane = F.pmod(F.xxhash64("group"), F.lit(lanes)).cast("int")
    named = groups.select(
        F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"), lane.alias("lane"),
        F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
    )
    placed = blocks.withColumn("place", F.pmod(F.xxhash64("block"), F.lit(places)).cast("int"))
    placed = placed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # a number of partitions, since little data means much work here and must not be drawn together
    dealt, placed = (x.repartition(parts, "place", "lane") for x in (named, placed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, lists = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if held != row.block:
                    held, lists = row.block, Lists(row.dims, row.ids, row.data, row.lists)
                q_ids = np.frombuffer(row.q_ids, "<i8").tolist()
                matrix = np.frombuffer(row.q_data).reshape(len(q_ids), -1)
                found = [
                    (own, vec_id, min(max(score, _LONGS[0]), _LONGS[1]), number)
                    for number, (own, query) in enumerate(zip(q_ids, matrix, strict=True))
                    for score, vec_id in lists.best(query, own, k)
                ]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score", "number"]).astype("int64").assign(
                    vector=[matrix[x[3]].tobytes() for x in found]
                ).drop(columns="number")

    met = placed.join(dealt, ["place", "lane"]).select("block", "dims", "ids", "data", "lists", "q_dims", "q_ids", "q_data")
    tops = met.mapInPandas(run, "query_id long, vec_id long, score long, vector binary")
    first = Window.partitionBy("query_id", F.col("vector")).orderBy(F.desc("score"), "vec_id")
    ranked = tops.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    held = F.when(F.col("score").isin(*_LONGS), F.raise_error(F.lit("a score is beyond the range of a long"))).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", held.alias("score"))


def op2_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other rows for every row whose vec_id is divisible by 50."""
    rows = keep(quantized(table(spark, sf_dir, "embeddings")), "quantized")
    blocks = keep(index(rows), "index")
    return search(blocks, rows.filter("vec_id % 50 = 0").dropDuplicates(), 5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
