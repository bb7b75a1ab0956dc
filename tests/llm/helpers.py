"""Small frames for the edge cases every operator must handle."""

import os

from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"
HAVE_DATA = os.path.isdir(DATA)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Columns an operator might use for itself.
CLASHES = "id score size label text_ fp y share ids found kept rank path host target v u".split()


def documents(spark, texts, sources=None, ids=None):
    """A documents table with extra columns of clashing names."""
    rows = [
        (i if ids is None else ids[i], t, "en", "s" if sources is None else sources[i], None)
        for i, t in enumerate(texts)
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.selectExpr("*", *[f"'x' as {c}" for c in CLASHES])


ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "word",
    "word",
    "zwei Wörter",
    "a\x00b \x0b c\x0cd 漢字 😀 \u2028 e",
    "long " * 40_000,
    "x" * 200_000,
]
