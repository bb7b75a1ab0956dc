"""Substring matching of a text column against a table of needles, without comparing every
text with every needle once the needle table is large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.ordered import small

# Up to this many needles are carried along as one array value; more go through the gram join.
MAX_INLINE_NEEDLES = 2_000
MAX_GRAM = 8


def inline_array(needles: DataFrame, *fields: str):
    """The needle table as one array column, in ``seq`` order."""
    return needles.agg(
        F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("needles")
    ).scalar()


def gram_matches(texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str) -> DataFrame:
    """``(text, needle)`` for every distinct text that contains a needle (both as given).

    Every needle is looked up by whichever of its grams is rarest among the texts, so common
    grams such as ``https://`` are never join keys unless a needle has nothing else.
    """
    words = needles.select(F.col(needle_col).alias("needle")).where(F.length("needle") > 0).distinct()
    # Needles shorter than a gram are few at most (there are only so many short strings), and
    # are carried along; they must not turn single letters into the join keys of all others.
    brief = words.where(F.length("needle") < MAX_GRAM)
    found = short_matches(texts, text_col, brief)
    words = words.where(F.length("needle") >= MAX_GRAM)
    g = MAX_GRAM

    def grams(col: str):
        starts = F.sequence(F.lit(1), F.greatest(F.length(col) - g + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(col), i, F.lit(g))))

    # Grams travel with a short id; the text itself is fetched for the candidates only.
    docs = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    docs = docs.withColumn("doc", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    text_grams = docs.select("doc", F.explode(grams("text")).alias("gram"))
    needle_grams = words.select("needle", F.explode(grams("needle")).alias("gram"))
    used = needle_grams.select("gram").distinct()
    sizes = text_grams.join(used, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = needle_grams.join(sizes, "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")
    )
    candidates = text_grams.join(small(rarest), "gram").select("doc", "needle")
    long = (
        candidates.join(docs, "doc")
        .where(F.col("text").contains(F.col("needle")))
        .select("text", "needle")
    )
    return long.unionByName(found)


def short_matches(texts: DataFrame, text_col: str, needles: DataFrame) -> DataFrame:
    """The same for needles shorter than a gram: each is a substring of a text of its own length
    or it is not, so substrings of the lengths that occur are joined with the needles."""
    lengths = [r[0] for r in needles.select(F.length("needle")).distinct().collect()]
    docs = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    pieces = F.flatten(
        F.array(
            *[
                F.when(
                    F.length("text") >= n,
                    F.transform(
                        F.sequence(F.lit(1), F.length("text") - (n - 1)),
                        lambda i, n=n: F.substr(F.col("text"), i, F.lit(n)),
                    ),
                ).otherwise(F.array().cast("array<string>"))
                for n in lengths
            ]
        ).cast("array<array<string>>")
    )
    cut_up = docs.select("text", F.explode(F.array_distinct(pieces)).alias("needle"))
    return cut_up.join(needles, "needle").select("text", "needle")
