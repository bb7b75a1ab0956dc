"""Tables that a stream adds to, safe against replayed micro-batches.

A micro-batch writes its rows into a folder of its own and reads only what earlier batches wrote. Running it again
overwrites the folder with the same rows, so a stream that was killed anywhere goes on from its
checkpoint as if nothing had happened. Rows are bucketed by a hash of their key, and a batch reads the
buckets of its own keys only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from postloom.sources.store import _fs, path_exists

BUCKETS = 256
COMPACT_EVERY = 50
BATCH = "__batch"


@dataclass(frozen=True)
class BatchTable:
    """``root`` holds ``batch=<id>`` folders, and ``upto=<id>`` folders with all rows of batches before ``id``.

    With ``latest`` a key has one current row, that of its newest batch; otherwise all rows count.
    """

    spark: SparkSession
    root: str
    schema: StructType
    keys: list[str]
    latest: bool = False
    buckets: int = BUCKETS
    compact_every: int = COMPACT_EVERY
    stored: StructType = field(init=False)

    def __post_init__(self):
        extra = [StructField(BATCH, LongType()), StructField("__bucket", IntegerType())]
        object.__setattr__(self, "stored", StructType([*self.schema.fields, *extra]))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The rows that batch ``batch_id`` adds; a second call replaces the first."""
        placed = rows.select(*self.schema.fieldNames()).withColumn(BATCH, F.lit(batch_id).cast("long"))
        self._save(placed, f"batch={batch_id}")

    def before(self, batch_id: int, touched: DataFrame | None = None) -> DataFrame:
        """Rows of the batches before ``batch_id``. ``touched`` has the key columns: only rows in the
        buckets of its keys are read, others may be missing."""
        rows = self._read(batch_id)
        if touched is not None:
            # No more numbers than there are buckets reach the driver.
            hit = [r["b"] for r in touched.select(self.bucket().alias("b")).distinct().collect()]
            rows = rows.where(F.col("__bucket").isin(hit)) if hit else rows.where("false")
        return self._current(rows).select(*self.schema.fieldNames())

    def all(self) -> DataFrame:
        """Rows of all batches."""
        return self.before(1 << 62)

    def compact(self, batch_id: int) -> bool:
        """Every ``compact_every`` batches, join the folders of earlier batches into one and delete
        them. It is called within batch ``batch_id``, before the batch is written."""
        folders = self._folders("batch")
        if len([b for b in folders if b < batch_id]) < self.compact_every:
            return False
        old = [b for b in self._folders("upto") if b < batch_id]
        self._save(self._current(self._read(batch_id)).drop("__bucket"), f"upto={batch_id}")
        for name in [f"batch={b}" for b in folders if b < batch_id] + [f"upto={b}" for b in old]:
            fs, path = _fs(self.spark, f"{self.root}/{name}")
            fs.delete(path, True)
        return True

    def _save(self, rows: DataFrame, folder: str) -> None:
        dealt = rows.withColumn("__bucket", self.bucket()).repartition("__bucket")
        dealt.write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.root}/{folder}")

    def _current(self, rows: DataFrame) -> DataFrame:
        if not self.latest:
            return rows
        rest = [c for c in self.stored.fieldNames() if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), BATCH).alias("row"))
        return newest.select(*self.keys, "row.*").select(*self.stored.fieldNames())

    def _folders(self, kind: str) -> list[int]:
        """Ids of the folders that were written to the end."""
        fs, path = _fs(self.spark, self.root)
        if not fs.exists(path):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        ids = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        return sorted(i for i in ids if path_exists(self.spark, f"{self.root}/{kind}={i}/_SUCCESS"))

    def _read(self, batch_id: int) -> DataFrame:
        whole = max((b for b in self._folders("upto") if b <= batch_id), default=0)
        names = [f"upto={whole}"] if whole else []
        names += [f"batch={b}" for b in self._folders("batch") if whole <= b < batch_id]
        rows = self.spark.createDataFrame([], self.stored)
        for name in names:
            part = self.spark.read.schema(self.stored).parquet(f"{self.root}/{name}")
            rows = rows.unionByName(part)
        return rows
