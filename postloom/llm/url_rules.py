"""URL filter: host-suffix and path-prefix expressions looked up by short hash prefixes.

A rule names a host and the start of a path. It fits the host and all its subdomains, and
every path that starts with the rule's. A URL is expanded into the expressions it could be
listed under; those are equi-joined with the rules on the first four bytes of their SHA-256,
the full digests confirm a match, and the longest confirmed expression decides. Everything
is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_HEX_DIGITS = 8

# Rules of the registered query: fixed values (host, path, verdict).
QUERY_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given in code as a frame, without leaving the JVM at run time."""
    rows = [
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
        for h, p, v in rules
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. The host follows the first ``://``; A-Z are lower-cased, nothing else is
    changed (ports and user names stay). Null, or no ``://``: both empty."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(__url, locate('://', __url) + 3)"))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_HEX_DIGITS), 16, 10).cast("long")


def _packed(host_length: Column, path_length: Column, blocks: Column) -> Column:
    """Precedence as one long: total length, then host length, then block before allow. Two
    expressions of one URL with equal lengths are the same text, so the long also names it."""
    total = (host_length + path_length).cast("long")
    return (
        F.shiftleft(total, 32)
        .bitwiseOR(F.shiftleft(host_length.cast("long"), 1))
        .bitwiseOR(blocks.cast("long"))
    )


def hashed_rules(rules: DataFrame) -> DataFrame:
    """``(prefix, digest, packed)``, one row per expression. A rule given twice with both
    verdicts blocks. Rules with a null or empty host fit nothing; a null path is empty."""
    host = F.translate("host", UPPER, UPPER.lower())
    path = F.coalesce("path", F.lit(""))
    return (
        rules.where(F.coalesce(F.length("host"), F.lit(0)) > 0)
        .select(host.alias("h"), path.alias("p"), (F.col("verdict") == "block").alias("b"))
        .groupBy("h", "p")
        .agg(F.max(F.coalesce("b", F.lit(False))).alias("b"))
        .select(
            F.sha2(F.concat("h", F.lit("\n"), "p").cast("binary"), 256).alias("rule_digest"),
            _packed(F.length("h"), F.length("p"), F.col("b").cast("int")).alias("packed"),
        )
        .withColumn("rule_prefix", _prefix(F.col("rule_digest")))
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``(id_col, url_col, host, path, rule, verdict)``, one row for every row of ``pages``.

    * ``rule`` is the longest fitting rule as host and path joined, null if none fits; then the
      verdict is ``default``.
    * Null or empty URLs have an empty host and path, and no rule fits them. Repeated rows stay
      repeated. Other columns of ``pages``, whatever their names, are ignored. No rules, or an
      empty table: every page gets the default.

    A URL is expanded only to as many host labels, and to such path lengths, as some rule has;
    other expressions cannot match. So long URLs make no more rows than short ones.
    """
    shape = rules.where(F.coalesce(F.length("host"), F.lit(0)) > 0).agg(
        F.max(F.size(F.split("host", r"\."))),
        F.array_sort(F.collect_set(F.length(F.coalesce("path", F.lit(""))))),
    )
    labels, lengths = shape.first()
    base = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    host, path = split_url(F.col("__url"))
    split = base.select("__id", "__url", host.alias("__host"), path.alias("__path"))
    if not labels:
        best = split.withColumn("__best", F.lit(None).cast("long"))
        return _named(best, id_col, url_col, default)

    own_labels = F.size(F.split("__host", r"\."))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(labels), own_labels)),
        lambda n: F.substring_index(F.col("__host"), ".", -1) if labels == 1 else F.call_function(
            "substring_index", F.col("__host"), F.lit("."), -n
        ),
    )
    starts = F.filter(
        F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("__path")
    )
    expressions = F.flatten(
        F.transform(
            suffixes,
            lambda h: F.transform(
                starts, lambda n: F.concat(h, F.lit("\n"), F.col("__path").substr(F.lit(1), n))
            ),
        )
    )
    # The leading null stands for the URL itself, so that rows are counted even if nothing fits.
    keyed = split.select(
        "__id",
        "__url",
        F.explode(F.concat(F.array(F.lit(None).cast("string")), expressions)).alias("__expr"),
    )
    keyed = keyed.withColumn("__digest", F.sha2(F.col("__expr").cast("binary"), 256))
    keyed = keyed.withColumn("__prefix", _prefix(F.col("__digest")))
    found = keyed.join(hashed_rules(rules), F.col("__prefix") == F.col("rule_prefix"), "left")
    confirmed = F.when(F.col("__digest") == F.col("rule_digest"), F.col("packed"))
    # One prefix may belong to several rules, which repeats expressions but never the null.
    best = (
        found.groupBy("__id", "__url")
        .agg(
            F.max(confirmed).alias("__best"),
            F.sum(F.col("__expr").isNull().cast("int")).alias("__rows"),
        )
        .select("__id", "__url", "__best", F.explode(F.expr("array_repeat(0, int(__rows))")))
    )
    best = best.select("__id", "__url", "__best", host.alias("__host"), path.alias("__path"))
    return _named(best, id_col, url_col, default)


def _named(best: DataFrame, id_col: str, url_col: str, default: str) -> DataFrame:
    host_length = F.shiftright(F.col("__best"), 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    path_length = (F.shiftright(F.col("__best"), 32) - host_length).cast("int")
    rule = F.concat(
        F.right(F.col("__host"), host_length), F.col("__path").substr(F.lit(1), path_length)
    )
    blocks = F.col("__best").bitwiseAND(F.lit(1)) == 1
    return best.select(
        F.col("__id").alias(id_col),
        F.col("__url").alias(url_col),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.when(F.col("__best").isNotNull(), rule).alias("rule"),
        F.when(F.col("__best").isNull(), F.lit(default))
        .when(blocks, F.lit("block"))
        .otherwise(F.lit("allow"))
        .alias("verdict"),
    )
