"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where more than half the hashes of its word shingles have
it. Fingerprints within a few bits of each other are linked. To find such pairs without
comparing all, a fingerprint is cut into two 32-bit segments with a lookup table each: if two
fingerprints differ in at most three bits, one of their segments differs in at most one bit.
So each fingerprint enumerates the Hamming ball of radius one around each of its segments,
fetches the table rows stored under those values, and verifies the complete distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.graph import components
from postloom.session import cut

SEED = 42
SEGMENT_BITS = 32
MAX_DISTANCE = 3  # what a ball of radius one in one of two segments can promise
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and every shingle
    counts as often as it occurs. Fewer words than ``width`` make one shingle of them all; no
    word at all gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
        total = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    while chunk := b"".join([digest(s, SEED) for s in islice(shingles, HASHES_AT_ONCE)]):
        bits = np.unpackbits(np.frombuffer(chunk, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(
    documents: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, fp)``: the fingerprint of every row as a signed long."""
    id_type = documents.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(
                [fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64
            )
            fps = pa.array(values.view(np.int64), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=[id_col, "fp"])

    return documents.select(id_col, text_col).mapInArrow(run, schema)


def near_pairs(fps: DataFrame, distance: int = 2) -> DataFrame:
    """``(a, b)``, a < b: all pairs of distinct values of ``fp`` that differ in at most
    ``distance`` bits (three at most). ``fps`` must hold each value once."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"two segments with balls of radius 1 reach {MAX_DISTANCE} bits at most")
    low = (1 << SEGMENT_BITS) - 1

    def segment(number: int):
        shifted = F.shiftrightunsigned("fp", SEGMENT_BITS) if number else F.col("fp")
        return shifted.bitwiseAND(F.lit(low))

    table = fps.select(
        F.col("fp").alias("b"),
        F.posexplode(F.array(segment(0), segment(1))).alias("table", "value"),
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(SEGMENT_BITS)])
    balls = (
        fps.select(
            F.col("fp").alias("a"),
            F.posexplode(F.array(segment(0), segment(1))).alias("table", "centre"),
        )
        .select("a", "table", "centre", F.explode(flips).alias("flip"))
        .select("a", "table", F.col("centre").bitwiseXOR(F.col("flip")).alias("value"))
    )
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    on = (
        (balls["table"] == table["table"])
        & (balls["value"] == table["value"])
        & (F.col("a") < F.col("b"))
        & (apart <= distance)
    )
    return balls.join(table.hint("shuffle_hash"), on).select("a", "b").distinct()


def near_duplicates(
    documents: DataFrame,
    width: int = 3,
    distance: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, fp, component_id)`` for every row of ``documents``.

    Rows with equal fingerprints, and rows whose fingerprints differ in at most ``distance``
    bits, are linked; ``component_id`` is the smallest id reachable over links, the row's own
    included.

    * Copies meet in one distinct fingerprint before any join, so a group of copies costs one
      row. Only distinct fingerprints are paired, and what a lookup makes is verified inside it.
    * Null and empty texts have fingerprint zero and are linked like others. Repeated rows stay
      repeated. Rows with a null id are labelled by the ids they reach, null if there are none.
      Other columns are ignored; an empty table gives an empty result.
    """
    found = cut(fingerprints(documents, width, id_col, text_col), "fingerprints")
    nodes = cut(found.groupBy("fp").agg(F.min(id_col).alias("label")), "fingerprint-classes")
    edges = cut(near_pairs(nodes.select("fp"), distance), "fingerprint-links")
    labels = components(nodes.withColumnRenamed("fp", "node"), edges)
    return found.join(labels.withColumnRenamed("node", "fp"), "fp").select(
        id_col, "fp", F.col("label").alias("component_id")
    )


def keep_first(
    documents: DataFrame,
    found: DataFrame,
    width: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of ``documents`` for each component: that of the smallest id. ``found`` is the
    result of :func:`near_duplicates` with the same ``width``. Rows without an id stay only
    where no id is linked to their text, and then one for each fingerprint."""
    kept = found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count()
    first = documents.join(kept.select(id_col), id_col, "left_semi")
    again = kept.where("count > 1").select(id_col)
    once = first.join(again, id_col, "left_anti").select(*documents.columns)
    one_of_many = first.join(again, id_col, "left_semi").dropDuplicates([id_col])
    lost = found.where(F.col(id_col).isNull() & F.col("component_id").isNull()).select("fp")
    nameless = documents.where(F.col(id_col).isNull()).select(
        F.struct(*documents.columns).alias("row"), F.col(text_col).alias("words")
    )
    nameless = (
        fingerprints(nameless, width, "row", "words")
        .join(lost.distinct(), "fp", "left_semi")
        .dropDuplicates(["fp"])
        .select("row.*")
    )
    return once.unionByName(one_of_many.select(*documents.columns)).unionByName(nameless)
