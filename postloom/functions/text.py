"""Column expressions for cleaning and keying text. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 25 characters that count as white space.
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The first half of the class turns ordinary characters away with a single range test.
WS = (
    r"[[^!-~]&&[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
)

# Titles too common to identify a posting.
GENERIC_TITLES = [
    "software engineer",
    "developer",
    "engineer",
    "manager",
    "director",
    "consultant",
    "analyst",
    "intern",
    "associate",
    "specialist",
    "coordinator",
    "lead",
    "architect",
    "qa",
    "tester",
    "sdet",
    "qa engineer",
    "qa analyst",
    "systems engineer",
    "staff engineer",
    "senior software engineer",
    "senior engineer",
    "admin",
    "administrator",
]

# Signs of a verification page, tested in this order. ``.`` is spelled out
# because the Java and JavaScript line-terminator sets differ.
CHALLENGE_SIGNALS = [
    ("reCAPTCHA detected", r"(?i)recaptcha"),
    ("hCaptcha detected", r"(?i)hcaptcha"),
    (
        "Cloudflare Turnstile / challenge detected",
        r"(?i)cf-turnstile|checking your browser|cloudflare[^\n\r\u2028\u2029]*challenge",
    ),
    ("PerimeterX detected", r"(?i)perimeterx|_px-captcha"),
    ("DataDome detected", r"(?i)datadome"),
    (
        "Generic human-verification phrasing detected",
        r"(?i)verify you are human|are you a robot|unusual traffic from your network"
        r"|complete the security check|please confirm you are a human",
    ),
    (
        "Access-denied / bot-block page detected",
        r"(?i)access denied[\s\S]{0,80}(?:bot|automated)|automated (?:queries|requests) detected",
    ),
]

# Every page that one of the signals matches holds one of these words, in lower case.
CHALLENGE_WORDS = [
    "captcha", "cf-turnstile", "checking your browser", "cloudflare", "perimeterx", "datadome", "verify you are human",
    "are you a robot", "unusual traffic", "complete the security check", "please confirm you are a human", "access denied",
    "automated queries", "automated requests",
]

MIN_FINGERPRINT_CHARS = 10


def trim_ws(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def collapse_ws(col: Column) -> Column:
    return F.regexp_replace(col, WS + "+", " ")


def falsy_or(*cols: Column) -> Column:
    """First column that is neither null nor the empty string; the last one as is."""
    *head, last = cols
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)


def clean_text(html: Column) -> Column:
    """Markup to plain text: drop script/style bodies, tags, two entities, extra space."""
    bare = F.regexp_replace(html, r"(?i)<(script|style)[^>]*>[\s\S]*?</\1>", " ")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    bare = F.regexp_replace(bare, r"(?i)&nbsp;", " ")
    bare = F.regexp_replace(bare, r"(?i)&amp;", "&")
    return F.trim(collapse_ws(bare))


def required_years(text: Column) -> Column:
    """First "N years"/"N+ yrs" mention as int, else null."""
    pattern = r"(?i)(\d{1,2})\+?" + WS + r"*(?:years|yrs)(?![A-Za-z0-9_])"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def fingerprint(text: Column) -> Column:
    return F.sha2(F.trim(collapse_ws(F.lower(text))), 256)


def norm_key(*parts: Column) -> Column:
    """Parts lower-cased, trimmed, with single spaces, joined by ``::`` (null counts as '')."""
    return F.concat_ws(
        "::", *[F.trim(collapse_ws(F.lower(F.coalesce(p, F.lit(""))))) for p in parts]
    )


def is_generic_title(title: Column) -> Column:
    words = F.trim(collapse_ws(F.lower(title)))
    words = F.regexp_replace(F.regexp_replace(words, r"[^a-z0-9 ]", ""), " +", " ")
    return words.isin(GENERIC_TITLES)


def has_usable_title(title: Column) -> Column:
    return (F.length(trim_ws(title)) > 0) & ~is_generic_title(title)


def has_fingerprintable(text: Column) -> Column:
    return F.length(trim_ws(text)) >= MIN_FINGERPRINT_CHARS


def challenge_page(title: Column, html: Column) -> Column:
    """The text that is searched for signals."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), html)


def challenge_reason(page: Column) -> Column:
    """Reason text of the first matching signal, else null. Give it a stored column: each
    signal reads it again."""
    (reason, pattern), *rest = CHALLENGE_SIGNALS
    found = reduce(
        lambda acc, s: acc.when(page.rlike(s[1]), s[0]), rest, F.when(page.rlike(pattern), reason)
    )
    # Plain words are looked for first: a page without any has no signal, and words are found much faster.
    low = F.lower(page)
    return F.when(reduce(or_, [low.contains(w) for w in CHALLENGE_WORDS]), found)


def with_clean_text(df: DataFrame, html_col: str, out: str = "descriptionText") -> DataFrame:
    return df.withColumn(out, clean_text(F.col(html_col)))


def with_required_years(df: DataFrame, text_col: str, out: str = "requiredYears") -> DataFrame:
    return df.withColumn(out, required_years(F.col(text_col)))


def with_fingerprint(df: DataFrame, text_col: str, out: str = "fingerprint") -> DataFrame:
    return df.withColumn(out, fingerprint(F.col(text_col)))


def with_challenge(
    df: DataFrame, title_col: str, html_col: str, out: str = "challenge"
) -> DataFrame:
    page = challenge_page(F.col(title_col), F.col(html_col))
    return df.withColumn("__page", page).withColumn(out, challenge_reason(F.col("__page"))).drop("__page")
