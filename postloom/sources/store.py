"""Reading and publishing the postings store, the listing log, the registry and progress."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from postloom.schemas import (
    LISTING,
    POSTING,
    PROGRESS,
    REGISTRY,
    SEEN_IDS,
    STORED_POSTING,
)

POINTER = "_current.json"


# --- files -----------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def _read_small(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _rename_into_place(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside ``path`` and move it over: readers see the old or the new one."""
    jvm = spark._jvm
    fs, tmp = _fs(spark, path + ".tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        tmp.toUri(), spark._jsc.hadoopConfiguration()
    )
    overwrite = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(tmp, jvm.org.apache.hadoop.fs.Path(path), overwrite)


# --- JSON lines ------------------------------------------------------------------------


def in_file_order(placed: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in the order of the splits, which ``order`` names, and of ``__n`` in each split.

    Each split counts its own lines; the offsets come from one row per split.
    """
    splits = placed.groupBy(*order).agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__lines"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("__offset", F.coalesce(F.sum("__lines").over(before), F.lit(0)))
    numbered = placed.join(offsets, order).withColumn(out, F.col("__n") - F.col("__first") + F.col("__offset"))
    return numbered.drop("__first", "__lines", "__offset")


def with_arrival_seq(df: DataFrame, start: int = 0) -> DataFrame:
    """Number the lines of a text-file scan in file order."""
    placed = df.withColumns(
        {
            "__file": F.col("_metadata.file_path"),
            "__start": F.col("_metadata.file_block_start"),
            "__n": F.monotonically_increasing_id(),
        }
    )
    numbered = in_file_order(placed, ["__file", "__start"], "seq")
    return numbered.withColumn("seq", F.col("seq") + F.lit(start)).drop("__file", "__start", "__n")


def _read_json_lines(
    spark: SparkSession, path: str, schema: StructType, start: int
) -> tuple[DataFrame, DataFrame]:
    bad_schema = StructType([StructField("line", StringType())])
    stored = StructType([StructField("seq", LongType()), *schema.fields])
    if not path_exists(spark, path):
        return spark.createDataFrame([], stored), spark.createDataFrame([], bad_schema)
    wide = StructType([StructField("seq", LongType()), *schema.fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = with_arrival_seq(lines, start).withColumn(
        "r", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt"})
    )
    readable = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    good = parsed.where(readable).withColumn("seq", F.coalesce("r.seq", "seq"))
    good = good.select("seq", *[f"r.{name}" for name in schema.fieldNames()])
    return good, parsed.where(~readable).select(F.col("value").alias("line"))


def read_postings(spark: SparkSession, path: str, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Postings and quarantined lines from JSON lines, or from a published store.

    A missing path gives empty frames. Lines without their own ``seq`` are numbered in file
    order from ``start``.
    """
    if path_exists(spark, f"{path}/{POINTER}"):
        return read_published(spark, path), spark.createDataFrame([], "line string")
    return _read_json_lines(spark, path, POSTING, start)


def read_listings(spark: SparkSession, path: str, start: int = 0) -> tuple[DataFrame, DataFrame]:
    return _read_json_lines(spark, path, LISTING, start)


def append_listings(df: DataFrame, path: str) -> None:
    """Add listings to the log. Files already there are never rewritten."""
    df.write.mode("append").json(path, ignoreNullFields=False)


# --- versioned store -------------------------------------------------------------------


def current_version(spark: SparkSession, root: str) -> int | None:
    if not path_exists(spark, f"{root}/{POINTER}"):
        return None
    return json.loads(_read_small(spark, f"{root}/{POINTER}"))["version"]


def _format(spark: SparkSession, root: str) -> str:
    return json.loads(_read_small(spark, f"{root}/{POINTER}"))["format"]


def read_published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = current_version(spark, root) if version is None else version
    if version is None:
        return spark.createDataFrame([], STORED_POSTING)
    ranges = read_ranges(spark, root, version)
    if ranges is not None:
        return load_ranges(spark, root, ranges).select(*STORED_POSTING.fieldNames())
    reader = spark.read.schema(STORED_POSTING)
    return reader.format(_format(spark, root)).load(f"{root}/v={version}/postings")


def read_keys(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """Key table published with a version, if it was."""
    version = current_version(spark, root) if version is None else version
    ranges = None if version is None else read_ranges(spark, root, version)
    if ranges is not None:
        return load_ranges(spark, root, ranges).select("seq", *KEY_COLUMNS)
    path = f"{root}/v={version}/keys"
    return spark.read.parquet(path) if version is not None and path_exists(spark, path) else None


def publish_postings(
    df: DataFrame,
    root: str,
    *,
    keys: DataFrame | None = None,
    version: int | None = None,
    fmt: str = "parquet",
) -> int:
    """Write a full new version, then point readers at it.

    The version being read is never touched, and writing the same version again replaces it.
    ``fmt`` may be ``parquet`` or ``json``. JSON lines are written in ``seq`` order, since
    there the order of the lines is the order of the store; Parquet rows carry it in ``seq``
    and are not shuffled for it.
    """
    spark = df.sparkSession
    if version is None:
        version = (current_version(spark, root) or 0) + 1
    target = f"{root}/v={version}"
    rows = df.select(*STORED_POSTING.fieldNames())
    if fmt == "json":
        rows.orderBy("seq").write.mode("overwrite").json(f"{target}/postings", ignoreNullFields=False)
    else:
        rows.write.mode("overwrite").format(fmt).save(f"{target}/postings")
    if keys is not None:
        keys.write.mode("overwrite").parquet(f"{target}/keys")
    pointer = json.dumps({"version": version, "format": fmt})
    _rename_into_place(spark, f"{root}/{POINTER}", pointer)
    return version


# --- ranged store ----------------------------------------------------------------------
#
# A version is a list of ranges of ``seq``, each a folder of Parquet files that may belong to an
# earlier version. A merge writes the ranges it changes and points at the others. Match keys are
# stored beside the postings, as columns of the same files.

RANGES = "ranges.json"
ROWS_PER_RANGE = 1_000_000
KEY_COLUMNS = ["k1", "k2", "k3", "k4"]
RANGED_POSTING = StructType(
    [*STORED_POSTING.fields, *[StructField(k, BinaryType()) for k in KEY_COLUMNS]]
)


def read_ranges(spark: SparkSession, root: str, version: int) -> list[dict] | None:
    """``lo, rows, version, range`` of each range in order; None if the version is not ranged."""
    path = f"{root}/v={version}/{RANGES}"
    return json.loads(_read_small(spark, path)) if path_exists(spark, path) else None


def load_ranges(spark: SparkSession, root: str, ranges: list[dict]) -> DataFrame:
    """Postings and keys of the given ranges."""
    if not ranges:
        return spark.createDataFrame([], RANGED_POSTING)
    paths = [f"{root}/v={r['version']}/ranges/range={r['range']}" for r in ranges]
    return spark.read.schema(RANGED_POSTING).parquet(*paths)


def range_index(seq: Column, bounds: list[int]) -> Column:
    """Index of the last bound at or below ``seq``; -1 below all of them."""
    starts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(IntegerType())
    def find(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, values.to_numpy(), side="right") - 1)

    return find(seq)


def split_points(seqs: DataFrame, rows_per_range: int) -> list[int]:
    """Lower bounds that cut ``seqs`` into ranges of about ``rows_per_range`` rows."""
    low, rows = seqs.agg(F.min("seq"), F.count(F.lit(1))).first()
    if not rows:
        return []
    parts = math.ceil(rows / rows_per_range)
    ranged = seqs.repartitionByRange(parts, "seq").groupBy(F.spark_partition_id().alias("part"))
    return sorted({int(low), *(int(r["lo"]) for r in ranged.agg(F.min("seq").alias("lo")).collect())})


def publish_ranges(
    rows: DataFrame, root: str, version: int, bounds: list[int], untouched: list[dict] | None = None
) -> None:
    """Write ``rows`` (postings with keys) as ranges that start at ``bounds``, and make a version
    of them and the ``untouched`` ranges. Writing the same version again replaces it."""
    spark = rows.sparkSession
    target = f"{root}/v={version}/ranges"
    placed = rows.select(*RANGED_POSTING.fieldNames()).withColumn("range", range_index(F.col("seq"), bounds))
    # A range is a bounded number of rows, but postings may be long: Spark deals a range out by its size, to a file a task.
    placed.hint("rebalance", "range").write.mode("overwrite").partitionBy("range").parquet(target)
    schema = StructType([RANGED_POSTING["seq"], StructField("range", IntegerType())])
    found = spark.read.schema(schema).parquet(target).groupBy("range")
    written = [
        {"lo": r["lo"], "rows": r["n"], "version": version, "range": r["range"]}
        for r in found.agg(F.min("seq").alias("lo"), F.count(F.lit(1)).alias("n")).collect()
    ]
    ranges = sorted([*(untouched or []), *written], key=lambda r: r["lo"])
    _rename_into_place(spark, f"{root}/v={version}/{RANGES}", json.dumps(ranges))
    _rename_into_place(spark, f"{root}/{POINTER}", json.dumps({"version": version, "format": "parquet"}))


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete versions that neither belong to the newest ``keep`` nor hold a range of theirs."""
    newest = current_version(spark, root)
    if newest is None:
        return []
    used = set(range(newest - keep + 1, newest + 1))
    for version in list(used):
        used |= {r["version"] for r in read_ranges(spark, root, version) or []} if version > 0 else set()
    dropped = []
    for version in range(1, newest):
        fs, target = _fs(spark, f"{root}/v={version}")
        if version not in used and fs.exists(target):
            fs.delete(target, True)
            dropped.append(version)
    return dropped


# --- registry and progress -------------------------------------------------------------


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Company registry from a JSON array; ``seq`` is the position in the array."""
    entry = StructType(REGISTRY.fields[1:]).simpleString()
    text = spark.read.text(path, wholetext=True)
    return text.select(
        F.posexplode(F.from_json("value", f"array<{entry}>")).alias("seq", "r")
    ).select(F.col("seq").cast("long").alias("seq"), "r.*")


def read_progress(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Progress rows and seen ids; empty when nothing (readable) is there.

    A plain JSON object keyed by ``source::keyword::location`` is accepted as well.
    """
    nothing = spark.createDataFrame([], PROGRESS), spark.createDataFrame([], SEEN_IDS)
    if not path_exists(spark, root):
        return nothing
    if path_exists(spark, f"{root}/{POINTER}"):
        version = current_version(spark, root)
        return (
            spark.read.schema(PROGRESS).parquet(f"{root}/v={version}/progress"),
            spark.read.schema(SEEN_IDS).parquet(f"{root}/v={version}/seen"),
        )
    fields = PROGRESS.simpleString().removeprefix("struct<").removesuffix(">")
    text = spark.read.text(root, wholetext=True)
    parsed = text.select(
        F.explode(F.from_json("value", f"map<string,struct<{fields},sourceJobIds:array<string>>>"))
    ).select(F.col("key").alias("map_key"), "value.*")
    progress = parsed.select(F.col("map_key").alias("key"), *PROGRESS.fieldNames()[1:])
    seen = parsed.select(
        F.col("map_key").alias("key"), F.posexplode("sourceJobIds").alias("first_seq", "source_job_id")
    ).select("key", "source_job_id", F.col("first_seq").cast("long"))
    return progress, seen


def write_progress(progress: DataFrame, seen: DataFrame, root: str) -> int:
    """Publish progress and seen ids as one new version."""
    spark = progress.sparkSession
    version = (current_version(spark, root) or 0) + 1
    progress.select(*PROGRESS.fieldNames()).write.mode("overwrite").parquet(f"{root}/v={version}/progress")
    seen.select(*SEEN_IDS.fieldNames()).write.mode("overwrite").parquet(f"{root}/v={version}/seen")
    _rename_into_place(spark, f"{root}/{POINTER}", json.dumps({"version": version, "format": "parquet"}))
    return version
