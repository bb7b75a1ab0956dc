"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to the nearest of a few centroids, padded, rotated at random and
reduced to the signs of its components: the code. With the length of the remainder and the
inner product of remainder and code as correction scalars, the code gives an unbiased estimate
of any inner product, and a bound on its error. Within a tile, the candidates whose upper bound
reaches the k-th highest lower bound are scored again with their original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.tiles import ROWS_PER_SHARD, tiled_top, usable
from postloom.llm.topk import matrix_groups, select_top

SAMPLE_ROWS = 10_000  # vectors the centroids are fitted on, chosen by a hash of the id
CENTROIDS = 16
BITS = 256
EPSILON = 2.5  # how many standard deviations of the estimate the error bound allows


@dataclass
class Coder:
    """What the index is built with: fixed in size."""

    centroids: np.ndarray  # (centroids, dimensions)
    rotation: np.ndarray  # (bits, dimensions), orthonormal columns

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes, nearest centroids, lengths of the remainders, and how far the code
        vectors agree with the remainders' directions."""
        apart = -2 * vectors @ self.centroids.T + (self.centroids**2).sum(axis=1)
        nearest = apart.argmin(axis=1)
        rest = vectors - self.centroids[nearest]
        lengths = np.sqrt((rest**2).sum(axis=1))
        turned = rest @ self.rotation.T
        scale = np.where(lengths > 0, lengths, 1.0) * np.sqrt(len(self.rotation))
        agree = np.abs(turned).sum(axis=1) / scale
        codes = np.packbits(turned > 0, axis=1)
        return codes, nearest.astype(np.int32), lengths, agree


def fit(vectors: np.ndarray, centroids: int = CENTROIDS, bits: int = BITS, seed: int = 7) -> Coder:
    """k-means on a bounded sample, and a random rotation."""
    random = np.random.default_rng(seed)
    width = vectors.shape[1]
    centres = vectors[random.permutation(len(vectors))[:centroids]].copy()
    for _ in range(10):
        apart = -2 * vectors @ centres.T + (centres**2).sum(axis=1)
        nearest = apart.argmin(axis=1)
        for c in range(len(centres)):
            if (nearest == c).any():
                centres[c] = vectors[nearest == c].mean(axis=0)
    bits = max(bits, -(-width // 8) * 8)
    square, _ = np.linalg.qr(random.standard_normal((bits, bits)))
    return Coder(centres, square[:, :width])


def build_index(rows: DataFrame, coders: dict[int, Coder]) -> DataFrame:
    """Every row of ``rows`` (id, vector) with ``code``, ``centre``, ``length``, ``agree``."""
    schema = "id long, vector array<double>, code binary, centre int, length double, agree double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for at, matrix in matrix_groups(table["vector"], np.float64):
                if matrix.shape[1] not in coders:
                    continue
                codes, centre, length, agree = coders[matrix.shape[1]].encode(matrix)
                some = table.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        some["id"].combine_chunks(),
                        pa.array(list(matrix), pa.list_(pa.float64())),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(centre),
                        pa.array(length),
                        pa.array(agree),
                    ],
                    names=["id", "vector", "code", "centre", "length", "agree"],
                )

    return rows.mapInArrow(run, schema)


def best_estimates(k: int, coders: dict[int, Coder], epsilon: float):
    def tile(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        query_ids, row_ids = queries["id"].to_numpy(), rows["id"].to_numpy()
        centre, length, agree = (rows[c].to_numpy() for c in ("centre", "length", "agree"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_width = {m.shape[1]: (at, m) for at, m in matrix_groups(rows["vector"], np.float64)}
        packed = rows["code"].combine_chunks()
        for some, matrix in matrix_groups(queries["vector"], np.float64):
            width = matrix.shape[1]
            if width not in by_width:
                continue
            at, originals = by_width[width]
            coder, ids = coders[width], row_ids[at]
            code = np.frombuffer(
                b"".join(packed.take(pa.array(at)).to_pylist()), np.uint8
            ).reshape(len(at), -1)
            signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
            turned = (matrix @ coder.rotation.T).astype(np.float32)
            bits = signs.shape[1]
            sure = np.where(agree[at] > 0, agree[at], 1.0)
            along = (turned @ signs.T) * (length[at] / (sure * np.sqrt(bits)))
            about = (matrix @ coder.centroids.T)[:, centre[at]] + along
            spread = length[at] * np.sqrt(np.maximum(0, 1 / sure**2 - 1)) * epsilon / np.sqrt(bits - 1)
            size = np.sqrt((matrix**2).sum(axis=1))
            for i, query in enumerate(query_ids[some]):
                mine = np.nonzero(ids != query)[0]
                slack = spread[mine] * size[i] + 1e-6 * (1 + np.abs(about[i, mine]))
                if len(mine) > k:
                    low = about[i, mine] - slack
                    least = np.partition(low, len(low) - k)[len(low) - k]
                    mine = mine[about[i, mine] + slack >= least]
                # Summed row by row, so that equal vectors have equal scores.
                scores = (originals[mine] * matrix[i]).sum(axis=1)
                best = select_top(scores, ids[mine], k)
                found.append((np.full(len(best), query), ids[mine[best]], scores[best]))
        parts = list(zip(*found, strict=True)) if found else [[np.empty(0, np.int64)]] * 3
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate(parts[0]), pa.int64()),
                pa.array(np.concatenate(parts[1]), pa.int64()),
                pa.array(np.concatenate(parts[2]).astype(np.float64), pa.float64()),
            ],
            names=["query_id", "vec_id", "score"],
        )

    return tile


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    sample_rows: int = SAMPLE_ROWS,
    centroids: int = CENTROIDS,
    bits: int = BITS,
    epsilon: float = EPSILON,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` the ``k`` rows found
    nearest, or all if there are fewer; nearest first, ties to the smaller ``vec_id``. Nearness
    is the largest inner product, and ``score`` is that of the original vectors, as a double.

    Only centroids and rotation are fitted on a sample, of ``sample_rows`` vectors per length
    of vector at most; every vector is in the index. A larger ``epsilon`` scores more vectors
    again and misses fewer.

    * Vectors that are null, empty, zero or hold a null or non-finite component take no part,
      nor do rows without an id. Only vectors of equal length are compared.
    * A row is never its own candidate, nor are other rows with its id. A candidate row that is
      repeated counts each time; queries of the same id and vector count once. Other columns
      are ignored; an empty table gives an empty result.
    """
    wide = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    rows = usable(vectors, id_col, vector_col).select("id", wide)
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    asked = usable(vectors.where(is_query), id_col, vector_col).select("id", wide)
    asked = asked.where(F.exists("vector", lambda x: x != 0)).distinct()
    widths = [r[0] for r in asked.select(F.size("vector")).distinct().collect()]
    coders = {}
    for width in widths:
        some = (
            rows.where(F.size("vector") == width)
            .orderBy(F.xxhash64("id"), "id")
            .limit(sample_rows)
            .select("vector")
            .toArrow()
        )
        coders[width] = fit(matrix_groups(some["vector"], np.float64)[0][1], centroids, bits)
    index = build_index(rows, coders)
    return tiled_top(
        asked, index, best_estimates(k, coders, epsilon), "double", k, rows_per_shard=rows_per_shard
    )
