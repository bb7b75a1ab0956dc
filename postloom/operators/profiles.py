"""Search profiles: building searches from roles, tagging rows, counting tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.contains import MAX_INLINE_NEEDLES, gram_matches, inline_array
from postloom.operators.ordered import ordered_union, spread


def _none() -> Column:
    return F.array().cast("array<string>")


def role_searches(roles: DataFrame, profiles: list[str] | None = None) -> DataFrame:
    """``(search_no, keyword, profileIds)``: one row per lower-cased keyword."""
    if profiles is not None:
        roles = roles.where(F.col("profile").isin(profiles))
    words = roles.select("seq", "profile", F.posexplode("keywords").alias("pos", "word")).select(
        "seq", "pos", F.lower("word").alias("keyword"), F.array("profile").alias("profileIds")
    )
    first = words.groupBy("keyword").agg(F.min(F.struct("seq", "pos")).alias("at"))
    joined = first.join(ordered_union(words, ["keyword"], ["profileIds"], ["seq", "pos"]), "keyword")
    # Roles are configuration: a role holds fewer keywords than this factor.
    return joined.select(
        (F.col("at.seq") * 100_000 + F.col("at.pos")).alias("search_no"), "keyword", "profileIds"
    )


def match_profiles(
    df: DataFrame,
    text_col: str,
    searches: DataFrame,
    out: str = "matchedProfiles",
    inline_limit: int = MAX_INLINE_NEEDLES,
) -> DataFrame:
    """Tag each row with the profiles whose keyword occurs in the text, in search order."""
    needles = searches.select(
        F.col("search_no").alias("seq"), F.lower("keyword").alias("needle"), "profileIds"
    ).where(F.length("needle") > 0)
    if needles.count() <= inline_limit:
        hits = F.filter("__needles", lambda s: F.col("__low").contains(s["needle"]))
        tags = F.array_distinct(F.flatten(F.transform(hits, lambda s: s["profileIds"])))
        ready = spread(df).withColumns(
            {"__low": F.lower(text_col), "__needles": inline_array(needles, "needle", "profileIds")}
        )
        return ready.withColumn(out, F.coalesce(tags, _none())).drop("__low", "__needles")
    low = df.withColumn("__low", F.lower(text_col))
    pairs = gram_matches(low, "__low", needles, "needle").join(needles, "needle")
    tagged = ordered_union(pairs, ["text"], ["profileIds"], ["seq"]).withColumnRenamed("text", "__low")
    joined = low.join(tagged.withColumnRenamed("profileIds", "__tags"), "__low", "left")
    return joined.withColumn(out, F.coalesce("__tags", _none())).drop("__low", "__tags")


def profile_totals(df: DataFrame, col: str = "matchedProfiles") -> DataFrame:
    """``(profile, n)`` over a multi-valued tag."""
    # A plain explode first asks whether the array is empty, below every shuffle: tags would be worked out twice.
    tags = df.select(F.posexplode_outer(col).alias("at", "profile")).where(F.col("at").isNotNull())
    return tags.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))


def tag_listings(
    listings: DataFrame, roles: DataFrame, role_profile: str = "role_profile", per_keyword: bool = False
) -> DataFrame:
    """Tag listings found by a role's keyword.

    A title that contains the keyword gets the profile of every enabled role, in role order;
    any other gets the profile of the role that searched. With ``per_keyword`` the title is
    matched against all keywords instead, and only then falls back.
    """
    own = F.array(F.col(role_profile))
    if per_keyword:
        tagged = match_profiles(listings, "title", role_searches(roles), "__tags")
        return tagged.withColumn(
            "matchedProfiles", F.when(F.size("__tags") > 0, F.col("__tags")).otherwise(own)
        ).drop("__tags")
    everyone = roles.agg(
        F.array_distinct(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "profile"))), lambda r: r["profile"])
        )
    ).scalar()
    word = F.lower("searchKeyword")
    found = (F.length(word) > 0) & F.lower("title").contains(word)
    return listings.withColumn("matchedProfiles", F.when(found, everyone).otherwise(own))
