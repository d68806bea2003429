"""Operator 5: exact top-k inner products by block-at-a-time pruning.

Components are quantised to floor(64 x). Candidate rows, in the order of their
ids, form document-range blocks of ``BLOCK`` rows that keep the largest and the
least value of every dimension (term) beside a forward index, the rows' values.
For a query q, a block's bound is the sum over terms of max(q * most, q * least).
All blocks of a task's next ``HELD`` rows are taken in falling order of bound; a block is
scored through its forward index unless its bound is below the query's k-th score so
far, which is carried on through the task.

Queries go out in batches of ``QUERIES`` rows, so that what is broadcast has a
proven bound; every batch scans the packed blocks and writes its own result, and
a task keeps at most k rows for each query of the batch.

Rows whose vector is null or has null or non-finite components take no part.
Vectors of different length are padded with zeros. A row is no candidate for a
query of the same id. Scores whose sums might pass 2**53 use 64-bit integers.
An id is listed once for a query: repeated rows count once, and of an id with several
vectors, as query or as candidate, the highest score counts. Equal scores go to the
smaller id. Without queries, candidates or rows the result is empty. Columns beyond
vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import new_path, written

BLOCK = 128
STRETCH = 64 * BLOCK
#: Rows whose blocks are ordered together: 8 stretches, so 32 MB of 64 components.
HELD = 8 * STRETCH
QUERIES = 4096
PACKED = "n int, dim int, ids binary, data binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """id, v: array<long> of floor(64 x) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * 64)).alias("v"))


def _rows(values: pd.Series) -> np.ndarray:
    dim = max((len(v) for v in values), default=0)
    if all(len(v) == dim for v in values):
        return np.stack(values.to_list()).astype(np.int64) if len(values) else np.zeros((0, 0), np.int64)
    out = np.zeros((len(values), dim), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _pack(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows of up to ``size`` vectors each, as bytes."""
    for frame in frames:
        for at in range(0, len(frame), size):
            some = frame.iloc[at : at + size]
            data = _rows(some["v"])
            yield pd.DataFrame({"n": [len(some)], "dim": [data.shape[1]], "ids": [some["id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]})


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.data, np.int64).reshape(row.n, row.dim)


def _padded(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.hstack([x, np.zeros((len(x), dim - x.shape[1]), dtype=x.dtype)])


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    dim = max(x.shape[1] for _, x in parts)
    return np.concatenate([i for i, _ in parts]), np.vstack([_padded(x, dim) for _, x in parts])


class Best:
    """The k best (score, least id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, repeats: bool = False):
        """repeats: ids may occur more than once among the candidates."""
        self.ids, self.vectors, self.k, self.repeats = ids, vectors, k, repeats
        self.scored = 0  # rows scored through forward indexes, of all queries
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min, dtype=np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, dtype=np.int64)
        self.held = np.zeros(len(ids), dtype=np.int64)

    def kth(self) -> np.ndarray:
        return np.where(self.held >= self.k, self.score[:, -1], np.iinfo(np.int64).min)

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each of the queries q, a column for each candidate."""
        own = ids[None, :] == self.ids[q][:, None]
        count = np.minimum(self.held[q] + (~own).sum(axis=1), self.k)
        scores = np.where(own, np.iinfo(np.int64).min, scores)
        names = np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, scores.shape))
        both = np.hstack([self.score[q], scores])
        who = np.hstack([self.found[q], names])
        if self.repeats:  # of an id that is there twice the better score stays
            order = np.lexsort((-np.maximum(both, np.iinfo(np.int64).min + 1), who), axis=1)
            both, who = np.take_along_axis(both, order, axis=1), np.take_along_axis(who, order, axis=1)
            both[:, 1:][who[:, 1:] == who[:, :-1]] = np.iinfo(np.int64).min
            who[both == np.iinfo(np.int64).min] = np.iinfo(np.int64).max
            count = np.minimum((both > np.iinfo(np.int64).min).sum(axis=1), self.k)
        self.scored += scores.size
        order = np.lexsort((who, -np.maximum(both, np.iinfo(np.int64).min + 1)), axis=1)[:, : self.k]
        self.score[q] = np.take_along_axis(both, order, axis=1)
        self.found[q] = np.take_along_axis(who, order, axis=1)
        self.held[q] = count


def search(best: Best, ids: np.ndarray, data: np.ndarray) -> None:
    """Some candidates, block by block in each query's order of bounds."""
    dim = max(best.vectors.shape[1], data.shape[1])
    queries, data = _padded(best.vectors, dim), _padded(data, dim)
    most = lambda x: float(np.abs(x).max(initial=0))
    kind = np.float64 if most(queries) * most(data) * max(1, dim) < 2**53 else np.int64
    q, d = queries.astype(kind), data.astype(kind)
    cuts = range(0, len(d), BLOCK)
    top = np.stack([d[at : at + BLOCK].max(axis=0) for at in cuts])
    low = np.stack([d[at : at + BLOCK].min(axis=0) for at in cuts])
    bound = (np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T).astype(np.int64)
    order = np.argsort(-bound, axis=1, kind="stable")
    alive = np.arange(len(q))
    for turn in range(len(top)):
        block = order[alive, turn]
        # Bounds fall along the order: a query below its k-th score is done. Equal bounds may hold a smaller id.
        left = bound[alive, block] >= best.kth()[alive]
        alive, block = alive[left], block[left]
        if not len(alive):
            return
        for b in np.unique(block):
            own = alive[block == b]
            rows = slice(b * BLOCK, b * BLOCK + BLOCK)
            best.offer(own, ids[rows], (q[own] @ d[rows].T).astype(np.int64))


def ranked(found: DataFrame, k: int, repeats: bool) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query."""
    if repeats:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", nth.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = quantised(vectors)
    # Only ids are read to see whether any repeats; if so, vectors are spread within an id and each counts once.
    many = vectors.filter("vec_id is not null").select("vec_id").groupBy("vec_id").count().filter("count > 1")
    repeats = not many.isEmpty()
    keys = ["id", "v"] if repeats else ["id"]
    rows = rows.distinct() if repeats else rows
    # Ranges of ids, in blocks that are small next to a partition.
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    packed = written(ranged.mapInPandas(lambda it: _pack(it, STRETCH), PACKED), "topk-blocks")
    asked = written(rows.filter(is_query(F.col("id"))).mapInPandas(lambda it: _pack(it, QUERIES), PACKED), "topk-queries")
    schema = "query_id long, vec_id long, score long"
    out = new_path(spark, "topk-result")
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    nothing.write.parquet(out)

    def send(ids: np.ndarray, vectors_: np.ndarray) -> None:
        shared = spark.sparkContext.broadcast((ids, vectors_))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = Best(*shared.value, k, repeats)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for row in (row for frame in frames for row in frame.itertuples(index=False)):
                held.append(_unpack(row))
                if sum(len(ids) for ids, _ in held) >= HELD:
                    search(best, *_joined(held))
                    held = []
            if held:
                search(best, *_joined(held))
            q, nth = np.nonzero(np.arange(k)[None, :] < best.held[:, None])
            yield pd.DataFrame({"query_id": best.ids[q], "vec_id": best.found[q, nth], "score": best.score[q, nth]})

        ranked(packed.mapInPandas(run, schema), k, repeats).write.mode("append").parquet(out)
        shared.unpersist()

    pending: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for row in asked.toLocalIterator():
        pending.append(_unpack(row))
        held += row.n
        if held >= QUERIES:
            send(*_joined(pending))
            pending, held = [], 0
    if pending:
        send(*_joined(pending))
    found = spark.read.schema(nothing.schema).parquet(out)
    return ranked(found, k, repeats) if repeats else found  # an id's vectors may have gone out in several batches


ORACLE = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
           max(CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2])) AS BIGINT)) AS score
    FROM v q JOIN v d ON q.vec_id <> d.vec_id
    WHERE q.vec_id % 20 = 0
    GROUP BY q.vec_id, d.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
