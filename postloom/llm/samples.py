"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(labels: DataFrame, label: str, where: Column | None, id_col: str) -> DataFrame:
    """``(id_col, y)``: one row per id; of several labels of an id the smallest holds. Rows with
    a null id or label, or outside ``where``, are left out."""
    known = labels.select(F.col(id_col), F.col(label).cast("int").alias("y")).dropna()
    if where is not None:
        known = known.where(where)
    return known.groupBy(id_col).agg(F.min("y").alias("y")).where(F.col("y").isin(0, 1))


def sample(known: DataFrame, most: dict[int, int], id_col: str, seed: int) -> DataFrame:
    """``(id_col, y, share)``: about ``most[y]`` rows of each class, chosen by a hash of the
    id, with the share of the class they are. Two numbers reach the driver."""
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    cells = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(cells))
    share = F.lit(0.0)
    for y, limit in most.items():
        share = F.when(F.col("y") == y, min(1.0, limit / max(1, counts.get(y, 0)))).otherwise(share)
    return known.withColumn("share", share).where(draw < F.col("share") * cells)


def with_texts(documents: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of the sampled ids. The sample has a bounded size, so it is sent to the documents
    and no text is shuffled."""
    return documents.select(id_col, text_col).join(F.broadcast(chosen), id_col)
