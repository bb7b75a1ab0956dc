"""Exact top-k search by tiled matrix products.

The scores of a tile are one matrix product; a partial selection keeps the best k of each
query, and the lists of a query are merged in a tree. Scores are integers and exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.tiles import ROWS_PER_SHARD, tiled_top, usable

LONG = 1 << 63
EXACT_DOUBLE = float(1 << 53)


def matrix_groups(column: pa.ChunkedArray, dtype) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], column.type)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    groups = []
    for length in np.unique(lengths):
        rows = np.nonzero(lengths == length)[0]
        at = offsets[rows][:, None] + np.arange(length)
        groups.append((rows, values[at].astype(dtype)))
    return groups


def integer_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; what leaves the range of a long is clamped."""
    reach = queries.shape[1] * float(np.abs(queries.astype(float)).max(initial=0)) * float(
        np.abs(rows.astype(float)).max(initial=0)
    )
    if reach < EXACT_DOUBLE:  # every partial sum is a whole number that a double holds
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -LONG, LONG - 1).astype(np.int64)


def select_top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id; ``ids`` is sorted."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.nonzero(scores > least)[0]
        ties = np.nonzero(scores == least)[0][: k - len(above)]
        return np.concatenate([above, ties])
    return np.arange(len(scores))


def best_products(k: int):
    def tile(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        query_ids = queries["id"].to_numpy()
        row_ids = rows["id"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_length = {m.shape[1]: (at, m) for at, m in matrix_groups(rows["vector"], np.int64)}
        for some, matrix in matrix_groups(queries["vector"], np.int64):
            if matrix.shape[1] not in by_length:
                continue
            at, others = by_length[matrix.shape[1]]
            ids = row_ids[at]
            scores = integer_scores(matrix, others)
            for i, query in enumerate(query_ids[some]):
                mine = np.nonzero(ids != query)[0]
                best = mine[select_top(scores[i, mine], ids[mine], k)]
                found.append((np.full(len(best), query), ids[best], scores[i, best]))
        parts = zip(*found, strict=True) if found else ([np.empty(0, np.int64)],) * 3
        columns = [pa.array(np.concatenate(list(p)), pa.int64()) for p in parts]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return tile


def exact_top(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` (over ``id_col``)
    the ``k`` rows of highest score, or all if there are fewer, ties to the smaller ``vec_id``.

    Components become floor(scale * x), x as a double; scores are integer inner products.

    * Vectors that are null, empty or hold a null or non-finite component take no part, nor do
      rows without an id. Only vectors of equal length are compared. Components and scores
      beyond the range of a long are clamped to it.
    * A row is never its own candidate, nor are other rows with its id. A candidate row that is
      repeated counts each time; queries of the same id and vector count once. Other columns
      are ignored; an empty table gives an empty result.
    """
    asked = usable(vectors.where(is_query), id_col, vector_col)
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = usable(vectors, id_col, vector_col).select("id", whole.alias("vector"))
    queries = asked.select("id", whole.alias("vector")).distinct()
    return tiled_top(queries, rows, best_products(k), "long", k, rows_per_shard=rows_per_shard)
