import pytest
from pyspark.sql import functions as F

from postloom.functions import text as T


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<h2>Night   <i>shift</i></h2>\n<span>?</span>", "Night shift ?"),
        ("<style>td{margin:1px}</style><td>Duty</td><script>go(7)</script>", "Duty"),
        ("<SCRIPT a=1>x</script><Style>y</STYLE>kept", "kept"),
        ("Pay&nbsp;by&nbsp;hour", "Pay by hour"),
        ("&amp;nbsp;", "&nbsp;"),
        (" a﻿b  c ", "a b c"),
        ("<script>never closed", "never closed"),
        ("", ""),
    ],
)
def test_clean_text(spark, html, expected):
    assert one(spark, html, T.clean_text) == expected


@pytest.mark.parametrize(
    "text, years",
    [
        ("At least 8 years in a lab", 8), ("4+ years with lathes", 4), ("5+yrs", 5), ("100 years", 0),
        ("3 yearsé", 3), ("3 yearsx", None), ("none", None), ("2 YEARS, 9 years", 2),
    ],
)
def test_required_years(spark, text, years):
    assert one(spark, text, T.required_years) == years


def test_fingerprint_ignores_case_and_space(spark):
    a = one(spark, "Bakers  WANTED\n\tfor early hours", T.fingerprint)
    assert a == one(spark, "bakers wanted for early hours", T.fingerprint)
    assert a != one(spark, "bakers wanted for late hours", T.fingerprint)
    assert len(a) == 64


def test_norm_key_null_and_space(spark):
    row = spark.createDataFrame([(" Acme  Inc ", None, "X")], "a string, b string, c string")
    assert row.select(T.norm_key(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "acme inc::::x"


@pytest.mark.parametrize(
    "title, generic, usable",
    [
        ("SDET", True, False), (" Software   Engineer! ", True, False), ("Engineer -", False, True),
        ("", False, False), ("  ", False, False), ("QA Automation Engineer", False, True),
    ],
)
def test_titles(spark, title, generic, usable):
    assert one(spark, title, T.is_generic_title) is generic
    assert one(spark, title, T.has_usable_title) is usable


def test_fingerprintable_needs_ten_characters(spark):
    assert one(spark, "  123456789\n", T.has_fingerprintable) is False
    assert one(spark, "  1234567890 ", T.has_fingerprintable) is True


@pytest.mark.parametrize(
    "title, html, reason",
    [
        (None, '<div class="g-ReCaptcha">', "reCAPTCHA detected"),
        (None, "hcaptcha.com", "hCaptcha detected"),
        (None, "Checking your browser before", "Cloudflare Turnstile / challenge detected"),
        (None, "cloudflare\nchallenge", None),
        ("cloudflare", "challenge", None),
        (None, "_px-captcha", "PerimeterX detected"),
        ("DataDome", "", "DataDome detected"),
        (None, "Please verify you are human", "Generic human-verification phrasing detected"),
        (None, "Access denied\n for any bot", "Access-denied / bot-block page detected"),
        ("Careers", "<h1>Open Roles</h1>", None),
    ],
)
def test_challenge(spark, title, html, reason):
    df = spark.createDataFrame([(title, html)], "t string, h string")
    assert T.with_challenge(df, "t", "h").first()["challenge"] == reason
