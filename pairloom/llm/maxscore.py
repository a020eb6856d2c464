"""Exact top-k search among track vectors by MaxScore."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.storage import stored

#: results per query; vectors of a shard, shards in a row group, queries in a block, components of a probe
TOP, SHARD_ROWS, GROUP_ROWS, BLOCK_QUERIES, PROBE = 5, 4096, 16384, 2048, 8


class Shard:
    """Postings of a block of integer vectors: per component and sign the rows, and the largest size."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.columns = np.ascontiguousarray(vectors.T)
        self.rows = {1: [np.flatnonzero(c > 0) for c in self.columns], -1: [np.flatnonzero(c < 0) for c in self.columns]}
        self.largest = {1: np.maximum(vectors.max(0), 0), -1: np.maximum(-vectors.min(0), 0)}

    def search(self, query: np.ndarray, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows that score ``floor`` or more; every row if it is None.

        A component is a term; its posting list holds the rows whose value has the query's sign, all
        others add nothing or less. The terms with the smallest bounds, which together stay below
        the floor, are non-essential: a row in none of the essential lists cannot reach it.
        """
        bounds = np.where(query > 0, query * self.largest[1], -query * self.largest[-1])
        order = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        if floor is None or floor <= 0:
            essential, rows = 0, np.arange(len(self.ids))
        else:
            essential = int((rest >= floor).sum())
            gained = np.zeros(len(self.ids), np.int64)
            for term in order[:essential]:
                listed = self.rows[1 if query[term] > 0 else -1][term]
                gained[listed] += query[term] * self.columns[term][listed]
            rows = np.flatnonzero((gained > 0) & (gained + rest[essential] >= floor))
        scores = self.vectors[np.ix_(rows, order[:essential])] @ query[order[:essential]]
        for at in range(essential, len(order), PROBE):
            if floor is not None:
                open_ = scores + rest[at] >= floor
                rows, scores = rows[open_], scores[open_]
            terms = order[at : at + PROBE]
            scores = scores + self.vectors[np.ix_(rows, terms)] @ query[terms]
        return rows, scores


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors):
        row[: len(vector)] = vector
    return out


def _best_of_group(tracks: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    found = []
    if len(tracks) and len(queries):
        width = max(tracks.vector.map(len).max(), queries.query_vector.map(len).max())
        shards = [
            Shard(part.track_id.to_numpy(), _matrix(part.vector, width))
            for part in (tracks.iloc[i : i + SHARD_ROWS] for i in range(0, len(tracks), SHARD_ROWS))
        ]
        for query_id, query in zip(queries.query_id, _matrix(queries.query_vector, width)):
            ids, scores, floor = np.empty(0, np.int64), np.empty(0, np.int64), None
            for shard in shards:
                rows, new = shard.search(query, floor)
                other = shard.ids[rows] != query_id
                ids, scores = np.append(ids, shard.ids[rows][other]), np.append(scores, new[other])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                floor = int(scores[-1]) if len(ids) == k else None
            found.append(pd.DataFrame({"query_id": query_id, "track_id": ids, "score": scores}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "track_id": [], "score": []}, dtype="int64")


def top_k_tracks(tracks: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, track_id, score): the ``k`` tracks with the largest integer inner product.

    ``tracks`` and ``queries`` have track_id and vector (array of integers). Both are dealt by hash,
    tracks into groups and queries into blocks of bounded size; a group meets every block once,
    shards of a group share the score floor that the earlier ones set, and the groups'
    lists are merged. Ties go to the smaller track_id, a query does not find itself, fewer than
    ``k`` others give fewer rows. Null ids, null vectors and vectors with a null component take no part;
    missing last components count as 0; repeated equal rows count once.
    """
    whole = F.col("track_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    rows = stored(tracks.where(whole).select(F.col("track_id").cast("long"), F.col("vector").cast("array<long>")).distinct())
    asked = stored(queries.where(whole).select(F.col("track_id").cast("long"), F.col("vector").cast("array<long>")).distinct())
    n_groups = max(1, -(-rows.count() // GROUP_ROWS))
    n_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def dealt(df: DataFrame, n: int):
        return F.pmod(F.xxhash64(*df.columns), F.lit(n))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = rows.select("track_id", "vector", dealt(rows, n_groups).alias("g"), every(n_blocks).alias("b"))
    right = asked.select(
        F.col("track_id").alias("query_id"), F.col("vector").alias("query_vector"),
        every(n_groups).alias("g"), dealt(asked, n_blocks).alias("b"),
    )
    best = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(
        lambda a, b: _best_of_group(a, b, k), "query_id long, track_id long, score long"
    )
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "track_id")
    return best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "track_id", "score")
