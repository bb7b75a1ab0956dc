"""Registration of queries, and SQL fragments shared by the reference statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = "2025-06-01T00:00:00.000Z"


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The white-space class in the notation DuckDB's regular expressions use.
WS = (
    r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)


def sql_clean(x: str) -> str:
    for pattern, to in [
        ("(?is)<script[^>]*>.*?</script>", " "),
        ("(?is)<style[^>]*>.*?</style>", " "),
        ("<[^>]+>", " "),
        ("(?i)&nbsp;", " "),
        ("(?i)&amp;", "&"),
        (WS + "+", " "),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x})"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{WS}+', ' ', 'g'))"


def sql_fingerprint(x: str) -> str:
    return f"sha256({sql_norm(x)})"


def sql_canonical(src: str, url: str = "u") -> str:
    """``select *, url_key`` for plain URLs of ``src``."""
    return f"""
    select * exclude (body, base, q, host, path, params),
      lower(split_part(base, '://', 1)) || '://' || lower(host)
      || case when length(path) <= 1 then '/' when path like '%/' then path[:-2] else path end
      || case when len(params) = 0 then '' else '?' || array_to_string(params, '&') end as url_key
    from (
      select *, split_part(substr(base, position('://' in base) + 3), '/', 1) as host,
        regexp_extract(base, '^[^:]+://[^/]*(.*)$', 1) as path,
        list_sort(list_filter(string_split(q, '&'), lambda x: x <> ''
          and not regexp_matches(x, '(?i)^(utm_|(gh_src|lever-source|ref|trk)(=|$))'))) as params
      from (
        select *, split_part(body, '?', 1) as base,
          case when contains(body, '?') then substr(body, position('?' in body) + 1) else '' end as q
        from (select *, regexp_replace({url}, '#.*$', '') as body from ({src}) s0) s1) s2) s3"""


def sql_years(x: str) -> str:
    pattern = r"(?i)(\d{1,2})\+?" + WS + r"*(?:years|yrs)(?:[^A-Za-z0-9_]|$)"
    return f"try_cast(nullif(regexp_extract({x}, '{pattern}', 1), '') as integer)"


GENERIC = (
    "'software engineer','developer','engineer','manager','director','consultant','analyst','intern',"
    "'associate','specialist','coordinator','lead','architect','qa','tester','sdet','qa engineer',"
    "'qa analyst','systems engineer','staff engineer','senior software engineer','senior engineer',"
    "'admin','administrator'"
)


def sql_generic(x: str) -> str:
    words = f"regexp_replace({sql_norm(x)}, '[^a-z0-9 ]', '', 'g')"
    return f"(regexp_replace({words}, ' +', ' ', 'g') in ({GENERIC}))"
