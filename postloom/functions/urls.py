"""URL keys. Ordinary web addresses are handled by native expressions; only the rest
(ports, user info, odd escapes, foreign hosts ...) goes to a vectorised helper."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postloom.functions.text import falsy_or

# Tracking parameters that never identify a page.
TRACKING_PREFIX = "utm_"
TRACKING_NAMES = ["gh_src", "lever-source", "ref", "trk"]

# What the native path accepts: http(s), a plain ASCII host whose last label starts with a
# letter, no port, a path without dot segments, a query of plain characters and ASCII escapes.
PLAIN_URL = (
    r"^(?i:https?)://"
    r"(?![^/?#]*(?i:xn--))(?:[A-Za-z0-9_-]+\.)*[A-Za-z][A-Za-z0-9_-]*"
    r"(?![^?#]*/(?:\.|%2[eE]){1,2}(?:[/?#]|\z))(?:/[A-Za-z0-9\-._~!$&'()*+,;=:@%/]*)?"
    r"(?:\?(?:[A-Za-z0-9*\-._+/:,@!$();~=&]|%[2-7][0-9A-Fa-f])*)?"
    r"(?:#[^\x00-\x20]*)?\z"
)


def is_plain_url(url: Column) -> Column:
    return url.rlike(PLAIN_URL)


# A query whose parameters need no decoding, and one tracking parameter inside it.
SIMPLE_QUERY = r"^[A-Za-z0-9*\-._&]*(?:=[A-Za-z0-9*\-._]*(?:&[A-Za-z0-9*\-._&]*|\z))*\z"
TRACKING_PARAM = (
    rf"(?i)(?:^|&)(?:{TRACKING_PREFIX}[^&=]*|{'|'.join(TRACKING_NAMES)})(?:=[^&]*)?(?=&|\z)"
)


def _sorted_params(params: Column) -> Column:
    """Parameters (name, at, text) joined in name order; ties keep their order."""
    return F.array_join(F.transform(F.array_sort(params), lambda p: p["text"]), "&")


def _simple_query(query: Column) -> Column:
    """For a query without escapes: most have no parameter left, or just one."""
    kept = F.regexp_replace(query, TRACKING_PARAM, "")
    kept = F.btrim(kept, F.lit("&"))
    many = F.transform(
        F.filter(F.split(kept, "&"), lambda p: p != ""),
        lambda p, i: F.struct(
            F.substring_index(p, "=", 1).alias("name"),
            i.alias("at"),
            F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("text"),
        ),
    )
    return (
        F.when(kept == "", F.lit(""))
        .when(kept.contains("&"), _sorted_params(many))
        .when(kept.contains("="), kept)
        .otherwise(F.concat(kept, F.lit("=")))
    )


def _escaped_query(query: Column) -> Column:
    """The same with parameters decoded and written again as a form."""
    params = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(
            F.url_decode(F.substring_index(p, "=", 1)).alias("name"),
            i.alias("at"),
            F.url_decode(F.regexp_replace(p, r"^[^=]*=?", "")).alias("value"),
        ),
    )
    kept = F.filter(
        params,
        lambda p: ~(
            F.lower(p["name"]).startswith(TRACKING_PREFIX)
            | F.lower(p["name"]).isin(TRACKING_NAMES)
        ),
    )
    written = F.transform(
        kept,
        lambda p: F.struct(
            p["name"],
            p["at"],
            F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])).alias("text"),
        ),
    )
    return _sorted_params(written)


def _plain_parts(df: DataFrame, url: Column) -> DataFrame:
    """Add the pieces of a plain URL, step by step so that each is worked out once."""
    body = F.substring_index(url, "#", 1)
    base, rest, host = F.col("__base"), F.col("__rest"), F.col("__host")
    return (
        df.withColumn("__body", body)
        .withColumn("__base", F.substring_index("__body", "?", 1))
        .withColumns(
            {
                "__query": F.substr("__body", F.length(base) + 2),
                "__rest": F.substr(base, F.locate("://", base) + 3),
            }
        )
        .withColumn("__host", F.substring_index(rest, "/", 1))
        .withColumn("__path", F.substr(rest, F.length(host) + 1))
    )


PARTS = ["__body", "__base", "__query", "__rest", "__host", "__path"]


def _plain_key() -> Column:
    """Canonical form from the pieces."""
    path, raw = F.col("__path"), F.col("__query")
    path = (
        F.when(F.length(path) <= 1, F.lit("/"))
        .when(path.endswith("/"), F.substr(path, F.lit(1), F.length(path) - 1))
        .otherwise(path)
    )
    query = (
        F.when(raw == "", F.lit(""))
        .when(raw.rlike(SIMPLE_QUERY), _simple_query(raw))
        .otherwise(_escaped_query(raw))
    )
    scheme = F.lower(F.substring_index("__base", "://", 1))
    whole = F.concat(scheme, F.lit("://"), F.lower("__host"), path, F.lit("?"), query)
    return F.rtrim(whole, F.lit("?"))


# Schemes with a host and their default ports.
SPECIAL_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_HOST_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_PATH_SAFE = "!$&'()*+,-./:;=@_~%[]|\\"


def _number(text: str) -> int | None:
    try:
        if text[:2].lower() == "0x":
            return int(text[2:] or "0", 16)
        return int(text, 8) if len(text) > 1 and text[0] == "0" else int(text)
    except ValueError:
        return None


def _host(raw: str) -> str | None:
    """Lower-case ASCII host, or None when the host is not valid."""
    if raw.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(raw.strip('[]')).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    from urllib.parse import unquote

    host = unquote(raw, errors="replace").lower()
    if not host.isascii() or "xn--" in host:
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if not host or _HOST_FORBIDDEN.search(host):
        return None
    labels = host[:-1].split(".") if host.endswith(".") else host.split(".")
    last = labels[-1]
    if last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last):
        nums = [_number(p) for p in labels]
        if len(nums) > 4 or any(n is None for n in nums) or any(n > 255 for n in nums[:-1]):
            return None
        tail = 256 ** (5 - len(nums))
        if nums[-1] >= tail:
            return None
        value = nums[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(nums[:-1]))
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    return host


def _dot_segments(path: str) -> str:
    parts = path.split("/")[1:]
    out: list[str] = []
    for i, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def _canonical_other(raw: str | None) -> str | None:
    """Canonical form of any URL, following the web URL standard; bad input comes back as is."""
    if raw is None:
        return None
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    match = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", text)
    if not match:
        return raw
    scheme = match[1].lower()
    rest = text[match.end() :].split("#", 1)[0]
    rest, _, query = rest.partition("?")
    port = ""
    authority = None
    if scheme in SPECIAL_PORTS:
        rest = rest.replace("\\", "/").lstrip("/") if scheme != "file" else rest.replace("\\", "/")
        if scheme == "file":
            return raw
        authority, slash, path = rest.partition("/")
        path = slash + path or "/"
    elif rest.startswith("//"):
        authority, slash, path = rest[2:].partition("/")
        path = slash + path
    else:
        path = rest
    if authority is not None:
        user, at, hostport = authority.rpartition("@")
        port_match = re.search(r":([0-9]*)\Z", hostport)
        host = hostport[: port_match.start()] if port_match else hostport
        if scheme in SPECIAL_PORTS:
            host = _host(host)
            if host is None:
                return raw
        else:
            host = quote(host, safe="!$&'()*+,-.;=_~%[]:")
        if port_match and port_match[1]:
            digits = port_match[1].lstrip("0") or "0"
            if len(digits) > 5 or int(digits) > 65535:
                return raw
            number = int(digits)
            if number != SPECIAL_PORTS.get(scheme):
                port = f":{number}"
        elif not port_match and re.search(r":[^\]]*\Z", hostport) and not hostport.startswith("["):
            return raw
        if at and user.strip(":"):
            name, colon, secret = user.partition(":")
            name = quote(name, safe="!$&'()*+,-._~%")
            secret = quote(secret, safe="!$&'()*+,-._~%:")
            user = name + (":" + secret if secret else "") + "@"
        else:
            user = ""
        prefix = f"{scheme}://{user}{host}{port}"
    else:
        prefix = f"{scheme}:"
    if authority is not None or path.startswith("/"):
        path = _dot_segments(quote(path, safe=_PATH_SAFE)) if path else path
        if len(path) > 1 and path.endswith("/"):
            path = path[:-1]
    params = parse_qsl(query, keep_blank_values=True, errors="replace")
    kept = [
        (name, value)
        for name, value in params
        if not (name.lower().startswith(TRACKING_PREFIX) or name.lower() in TRACKING_NAMES)
    ]
    kept.sort(key=lambda pair: pair[0].encode("utf-16-be"))
    form = urlencode(kept, safe="*").replace("~", "%7E")
    return prefix + path + ("?" + form if form else "")


def _canonical_or_raw(raw: str) -> str:
    """No URL, however odd, may end the job: what cannot be read comes back as it is."""
    try:
        return _canonical_other(raw) or raw
    except (ValueError, LookupError):
        return raw


@F.pandas_udf(StringType())
def _canonical_other_udf(urls: pd.Series) -> pd.Series:
    return urls.map(_canonical_or_raw, na_action="ignore")


def with_canonical_url(df: DataFrame, url_col: str, out: str = "url_key") -> DataFrame:
    """Add the canonical form of ``url_col``. Null stays null.

    Plain URLs never leave the JVM: the helper receives null for them and Arrow carries
    only the unusual ones.
    """
    url, plain = F.col(url_col), F.col("__plain")
    parts = _plain_parts(df.withColumn("__plain", is_plain_url(url)), url)
    other = _canonical_other_udf(F.when(~plain, url))
    return parts.withColumn(out, F.when(plain, _plain_key()).otherwise(other)).drop("__plain", *PARTS)


def job_id(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 16)


def with_job_id(df: DataFrame, url_col: str, out: str = "id") -> DataFrame:
    """First 16 hex digits of the SHA-256 of the canonical URL."""
    keyed = with_canonical_url(df, url_col, "__url_key")
    return keyed.withColumn(out, job_id(F.col("__url_key"))).drop("__url_key")


def ats_kind(url: Column) -> Column:
    """Hiring system recognised from the URL, else null."""
    low = F.lower(url)
    return (
        F.when(low.contains("greenhouse.io"), "greenhouse")
        .when(low.contains("lever.co"), "lever")
        .when(low.contains("myworkdayjobs.com"), "workday")
    )


def with_ats(df: DataFrame, url_col: str, out: str = "ats") -> DataFrame:
    return df.withColumn(out, ats_kind(F.col(url_col)))


def board_token(url: Column, configured: Column) -> Column:
    found = F.regexp_extract(url, r"(?i)boards\.greenhouse\.io/([^/?#]+)", 1)
    return falsy_or(configured, F.nullif(found, F.lit("")))


def lever_slug(url: Column, configured: Column) -> Column:
    found = F.regexp_extract(url, r"(?i)jobs\.lever\.co/([^/?#]+)", 1)
    return falsy_or(configured, F.nullif(found, F.lit("")))


def url_host(url: Column) -> Column:
    """Host of an http(s) URL, lower-cased; null when there is none."""
    return F.lower(
        F.nullif(
            F.regexp_extract(url, r"^\s*(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")
        )
    )


def url_path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^\s*(?i:https?)://[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("/"))


def workday_identity(url: Column, tenant: Column) -> Column:
    """Struct (hostname, tenant, site, guessed). The site falls back to ``careers``."""
    parts = F.split(url_path(url), "/")
    site = F.nullif(F.try_element_at(parts, F.lit(4)), F.lit(""))
    return F.struct(
        url_host(url).alias("hostname"),
        falsy_or(tenant, F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(""))).alias("tenant"),
        F.coalesce(site, F.lit("careers")).alias("site"),
        site.isNull().alias("guessed"),
    )


def with_ats_identity(
    df: DataFrame, url_col: str, ats_col: str = "ats", configured_col: str = "atsTenantOrBoardId"
) -> DataFrame:
    """Add ``board_token``, ``lever_slug`` and ``workday`` according to the ATS kind."""
    url, ats, given = F.col(url_col), F.col(ats_col), F.col(configured_col)
    return df.withColumns(
        {
            "board_token": F.when(ats == "greenhouse", board_token(url, given)),
            "lever_slug": F.when(ats == "lever", lever_slug(url, given)),
            "workday": F.when(ats == "workday", workday_identity(url, given)),
        }
    )


def detail_key(url: Column, ats: Column) -> Column:
    """Identifier of one posting inside its hiring system."""
    greenhouse = falsy_or(
        F.regexp_extract(url, r"(?i)jobs/(\d+)", 1), F.regexp_extract(url, r"jobs=([^&]+)", 1)
    )
    lever = F.regexp_extract(url, r"(?i)jobs\.lever\.co/[^/]+/([^/?#]+)", 1)
    workday = F.element_at(F.split(url, "/"), -1)
    return (
        F.when(ats == "greenhouse", F.nullif(greenhouse, F.lit("")))
        .when(ats == "lever", F.nullif(lever, F.lit("")))
        .when(ats == "workday", workday)
    )


def with_detail_key(
    df: DataFrame, url_col: str, ats_col: str = "ats", out: str = "detail_key"
) -> DataFrame:
    return df.withColumn(out, detail_key(F.col(url_col), F.col(ats_col)))


def encode_component(col: Column) -> Column:
    """Percent-encoding of a URL component (space is ``%20``; ``!'()~*`` stay)."""
    text = F.url_encode(col)
    for escaped, plain in [
        ("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"),
    ]:
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def search_url(
    source: Column, keyword: Column, location: Column, page: Column, template: Column | None = None
) -> Column:
    """Address of result page ``page`` for one (source, keyword, location) work item."""
    key, loc = encode_component(keyword), encode_component(location)
    url = (
        F.when(
            source == "indeed",
            F.format_string("https://www.indeed.com/jobs?q=%s&l=%s&start=%d", key, loc, (page - 1) * 10),
        )
        .when(
            source == "linkedin-public",
            F.format_string(
                "https://www.linkedin.com/jobs/search?keywords=%s&location=%s&start=%d",
                key, loc, (page - 1) * 25,
            ),
        )
        .when(
            source == "monster",
            F.format_string("https://www.monster.com/jobs/search?q=%s&where=%s&page=%d", key, loc, page),
        )
        .when(
            source == "google-jobs",
            F.format_string(
                "https://www.google.com/search?q=%s&ibp=htl;jobs",
                encode_component(F.concat_ws(" jobs ", keyword, location)),
            ),
        )
    )
    if template is None:
        return url
    filled = template
    for slot, value in [("{{keyword}}", key), ("{{location}}", loc), ("{{page}}", page.cast("string"))]:
        # Only the first occurrence is filled, as text and not as a pattern.
        at = F.locate(slot, filled)
        filled = F.when(
            at > 0, F.overlay(filled, value, at, F.lit(len(slot)))
        ).otherwise(filled)
    return F.coalesce(url, filled)
