"""Session defaults and the shared scratch folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole pages travel to the extraction jobs, so bound batches by size and not by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def get_session(app: str = "postloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session. Cluster settings given at submit time are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for cut lineages: ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with the machine, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and read it back.

    The returned frame has no lineage before the table, so a lost executor re-reads
    files instead of replaying the loop that made them. Unlike an RDD checkpoint it keeps
    column pruning and size statistics.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2_000, size: int = 1 << 20) -> None:
    """Bound the rows of a batch that travels to Python, and about its bytes, for all that the session runs from now on; lower bounds of
    the session's own stay. Spark's 10,000 whole texts are held by the task, on the way, and by its Python worker at the same time; buffers
    of many sizes beyond a few MB also leave memory of the executor in pieces that nothing else can use."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= size:
        spark.conf.set(key, str(size))


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote. Neither it nor anything not yet written that is made of it
    may be read afterwards."""
    spark = df.sparkSession
    root = scratch_root(spark).rstrip("/") + "/"
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        base = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toString() + "/"
        if fs.makeQualified(path).toString().startswith(base):
            fs.delete(path, True)
