"""Query blocks against shards: every query meets every candidate in one tile.

Queries are dealt over blocks and candidates over shards. A query is sent once to each shard
and a candidate once to each block; the rows of one (block, shard) form a tile of bounded size,
which a function reduces to the best few per query. Those lists are merged in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES_PER_BLOCK = 1024
ROWS_PER_SHARD = 8192
LISTS_PER_MERGE = 32


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part: with an id, and a vector that is not null
    and has only finite components (and at least one)."""
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        .where(F.col("id").isNotNull() & (F.size("vector") > 0))
        .where(~odd)
    )


def tiled_top(
    queries: DataFrame,
    candidates: DataFrame,
    best_of_tile: Callable[[pa.Table, pa.Table], pa.Table],
    score_type: str,
    k: int,
    queries_per_block: int = QUERIES_PER_BLOCK,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores of each query, ties to the
    smaller ``vec_id``.

    Both inputs have an ``id`` (long) and what ``best_of_tile`` needs; it gets the queries and
    the candidates of a tile and returns ``query_id, vec_id, score``. The numbers of blocks and
    shards follow the numbers of rows, so a tile never grows with the data.
    """
    spark = candidates.sparkSession
    blocks = max(1, math.ceil(queries.count() / queries_per_block))
    shards = max(
        4 * spark.sparkContext.defaultParallelism, math.ceil(candidates.count() / rows_per_shard)
    )
    # Shards are drawn by row, not by id: rows repeated many times spread over all shards.
    row = F.xxhash64(F.monotonically_increasing_id())
    left = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    right = candidates.withColumn("shard", F.pmod(row, F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )

    def tile(key: tuple[pa.Scalar, ...], some: pa.Table, rows: pa.Table) -> pa.Table:
        found = best_of_tile(some, rows)
        shard = pa.array([key[1].as_py()] * found.num_rows, pa.int64())
        return found.append_column("part", shard)

    lists = (
        left.groupBy("block", "shard")
        .cogroup(right.groupBy("block", "shard"))
        .applyInArrow(tile, f"query_id long, vec_id long, score {score_type}, part long")
    )
    while shards > 1:
        shards = math.ceil(shards / LISTS_PER_MERGE)
        lists = lists.withColumn("part", F.floor(F.col("part") / LISTS_PER_MERGE))
        order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")
