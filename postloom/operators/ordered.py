"""Order-aware building blocks that hold when one key owns a large share of all rows.

Each works in two steps: inside (key, block), where a block is one range of the ordering
column and so never larger than a fixed share of the table, and then across the few block
summaries of a key. No step brings a whole key to one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import cut

ROWS_PER_BLOCK = 2_000_000
SMALL_ROWS = 100_000
SPLIT_BYTES = 64 << 20


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; otherwise :func:`shuffled`."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked to be shuffled in a join, where Spark splits skewed partitions.

    Without the mark Spark goes by the size of the files, and millions of rows that Parquet packs into
    a few MB would be broadcast through the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """A small input often comes as one split. Deal it out over the cores before heavy work.

    Inputs that already fill the cores with splits of the usual size are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    few = int(size) < cores * SPLIT_BYTES
    return df.repartition(cores) if few else df


def block_count(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> int:
    return max(1, math.ceil(df.count() / rows_per_block))


def with_blocks(df: DataFrame, order_col: str, blocks: int) -> DataFrame:
    """Add ``__block``: the index of the range of ``order_col`` the row falls in.

    The ranges come from Spark's range partitioner, so they are balanced whatever the
    values look like. The frame is written out once so that every later use agrees.
    """
    if blocks <= 1:
        return df.withColumn("__block", F.lit(0))
    ranged = df.repartitionByRange(blocks, order_col)
    return cut(ranged.withColumn("__block", F.spark_partition_id()), "blocks")


def number_rows(df: DataFrame, order_cols: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in the order of ``order_cols``.

    Ranges are numbered side by side and shifted by the sizes of the ranges before them, so
    only one number per range meets in one task.
    """
    parts = parts or df.sparkSession.sparkContext.defaultParallelism
    ranged = df.repartitionByRange(parts, *order_cols).withColumn("__range", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    shifts = shifts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order_cols))
    return (
        ranged.join(shifts, "__range")
        .withColumn(out, (place - 1 + F.col("__shift")).cast("long"))
        .drop("__range", "__shift")
    )


def lag_in_key(
    df: DataFrame, keys: list[str], order_col: str, value_col: str, out: str, blocks: int | None = None
) -> DataFrame:
    """``lag(value) over (partition by keys order by order_col)`` for a unique ``order_col``."""
    if blocks is None:
        df = cut(df, "order")
        blocks = block_count(df)
    if blocks <= 1:
        whole = Window.partitionBy(*keys).orderBy(order_col)
        return df.withColumn(out, F.lag(value_col).over(whole))
    local = Window.partitionBy(*keys, "__block").orderBy(order_col)
    marked = (
        with_blocks(df, order_col, blocks)
        .withColumn("__pos", F.row_number().over(local))
        .withColumn("__next", F.lead(order_col).over(local))
        .withColumn(out, F.lag(value_col).over(local))
    )
    # The rows at the edges of a block, at most two per (key, block), carry it over.
    edges = marked.where((F.col("__pos") == 1) | F.col("__next").isNull())
    across = Window.partitionBy(*keys).orderBy(order_col)
    heads = edges.withColumn(out, F.lag(value_col).over(across)).where(F.col("__pos") == 1)
    return (
        marked.where(F.col("__pos") > 1).unionByName(heads).drop("__block", "__pos", "__next")
    )


def first_n_in_key(
    df: DataFrame, keys: list[str], order_col: str, n: int, blocks: int | None = None
) -> DataFrame:
    """Rows ranked 1..n per key by a unique ``order_col``.

    On a large table the position of the n-th row is found from the key and order columns
    alone; the wide rows are then only compared with it.
    """
    if n < 1:
        raise ValueError("n must be a positive integer")
    thin = df.select(*keys, order_col)
    if blocks is None:
        thin = cut(thin, "order")
        blocks = block_count(thin)
    if blocks <= 1:
        whole = Window.partitionBy(*keys).orderBy(order_col)
        ranked = df.withColumn("__rank", F.row_number().over(whole))
        return ranked.where(F.col("__rank") <= n).drop("__rank")
    blocked = with_blocks(thin, order_col, blocks)
    sizes = blocked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).where(
        F.col("__before") < n
    )
    local = Window.partitionBy(*keys, "__block").orderBy(order_col)
    ranked = blocked.join(starts, [*keys, "__block"]).withColumn(
        "__rank", F.row_number().over(local) + F.col("__before")
    )
    last = ranked.where(F.col("__rank") <= n).groupBy(*keys).agg(F.max(order_col).alias("__last"))
    return df.join(small(last), keys).where(F.col(order_col) <= F.col("__last")).drop("__last")


def ordered_union(
    df: DataFrame, keys: list[str], array_cols: list[str], order_cols: list[str]
) -> DataFrame:
    """Per key, the distinct elements of each array in order of first appearance.

    Elements are reduced to their first position before anything is gathered, so a group
    never holds more than its own result. Keys whose arrays are all empty give empty arrays.
    """
    def tag(name: str) -> Column:
        items = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.transform(
            items, lambda x, i: F.struct(F.lit(name).alias("col"), x.alias("elem"), i.alias("at"))
        )

    tagged = F.flatten(F.array(*[tag(c) for c in array_cols]))
    rows = df.select(*keys, *order_cols, F.explode_outer(tagged).alias("e"))
    firsts = rows.groupBy(*keys, F.col("e.col").alias("col"), F.col("e.elem").alias("elem")).agg(
        F.min(F.struct(*order_cols, F.col("e.at").alias("at"))).alias("first")
    )
    picked = [
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("col") == c, F.struct("first", "elem")))
            ),
            lambda x: x["elem"],
        ).alias(c)
        for c in array_cols
    ]
    return firsts.groupBy(*keys).agg(*picked)


def lookup_join(
    left: DataFrame, right: DataFrame, on: str, how: str = "left", hot_rows: int = 5_000_000
) -> DataFrame:
    """Equi-join a large ``left`` with a ``right`` that is unique on ``on``.

    A key carried by more than ``hot_rows`` left rows is spread over several salts and its
    single right row repeated for each. There can be at most ``rows / hot_rows`` such keys,
    so the list of them is small whatever the table size. Small inputs are joined as they are
    and Spark broadcasts whichever side its size limit allows.
    """
    if how not in ("left", "inner", "left_anti", "left_semi"):
        raise ValueError(f"unsupported join type: {how}")
    counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("__rows"))
    hot = counts.where((F.col("__rows") > hot_rows) & F.col(on).isNotNull())
    hot = hot.select(on, F.ceil(F.col("__rows") / hot_rows).cast("int").alias("__salts"))
    hot = cut(hot, "hot-keys")
    if hot.isEmpty():
        return left.join(right, on, how)
    salted = left.join(F.broadcast(hot), on, "left").withColumn(
        "__salt",
        F.pmod(F.xxhash64(*[c for c in left.columns]), F.coalesce("__salts", F.lit(1))).cast("int"),
    )
    copies = right.join(F.broadcast(hot), on, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    joined = salted.drop("__salts").join(copies.drop("__salts"), [on, "__salt"], how)
    return joined.drop("__salt")
