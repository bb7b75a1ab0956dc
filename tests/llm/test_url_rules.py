from postloom.llm.url_rules import QUERY_RULES, judge_urls, rule_table

URLS = [
    "http://Example.org/es/1", "https://a.b.example.org/en/17?x#y", "http://org/", "http://org", "http://xorg/",
    "http://notexample.org/es/", "https://a.com/fr/x", "https://com/de/", "http://user@h.com:80/de/", "ftp://e.com?/de/",
    "no scheme", "", None, "://", "http://", "http://a.example.org//es/", "a://b://c.org/", "http://.org/", "http://org./x",
    "http://ÄX.ORG/é", "http://" + "a." * 3000 + "org/" + "p" * 9000, "http://Example.org/es/1",
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [
        (len(h + p), len(h), v, h + p)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_against_brute_force(spark):
    df = spark.createDataFrame(
        [(i, u, "h", "p", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string"
    )
    more = [*QUERY_RULES, ("b.example.org", "/en/", "allow"), ("example.org", "", "block"), ("example.org", "", "allow")]
    for rules in (QUERY_RULES, more):
        got = judge_urls(df, rule_table(spark, rules)).collect()
        assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == [
            (i, *brute(u, rules)) for i, u in enumerate(URLS)
        ]


def test_repeated_rows_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "http://a.org/")] * 3 + [(1, None)], "page_id long, url string")
    rules = rule_table(spark, QUERY_RULES)
    assert sorted(r["verdict"] for r in judge_urls(df, rules).collect()) == ["allow"] * 4
    assert judge_urls(df.where("false"), rules).collect() == []
    none = judge_urls(df, rules.where("false"), default="block").collect()
    assert [(r["rule"], r["verdict"]) for r in none] == [(None, "block")] * 4
    odd = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    assert {r["rule"] for r in judge_urls(df, odd).collect()} == {"org", None}
