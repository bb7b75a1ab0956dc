"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import (
    ann,
    bpe,
    html_text,
    licences,
    mixing,
    ngram_join,
    prefix_trie,
    quality,
    simhash,
    strata,
    topk,
    toxicity,
    url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_digests(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    with open(rank_file, "rb") as file:
        ranks = file.read()
    encoded = bpe.encode_documents(documents, ranks)
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op1_toxicity_chain(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(documents, model).select(
        "doc_id",
        F.col("p_toxic").alias("score"),
        (F.col("p_toxic") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"),
        "p_dense",
        "p_recurring",
        "p_toxic",
    )


@query()
def op2_byte_bpe(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"))


@query()
def op3_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.struct("page_id", "url").alias("page"), "html"
    )
    return html_text.extract_text(pages, "page").select(
        "page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars")
    )


@query(mixing.SQL)
def op4_pareto_mix(spark, sf_dir):
    return mixing.pareto_mix(table(spark, sf_dir, "documents"))


@query(
    """
    with whole as (
      select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
      from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
      select q.vec_id as query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
      from whole q join whole c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
    )
    select query_id, rank::integer as rank, vec_id, score from (
      select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
    ) x where rank <= 10
    """
)
def op5_exact_top(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top(vectors, F.col("vec_id") % 100 == 0, k=10)


@query(
    r"""
    with urls as (
      select page_id, url, position('://' in url) as cut_at from pages
    ), parts as (
      select page_id,
        case when cut_at > 0 then translate(regexp_extract(substr(url, cut_at + 3), '^[^/?#]*'),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when cut_at > 0 then regexp_extract(substr(url, cut_at + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path,
        row_number() over () as n
      from urls
    ), rules(h, p, v) as (
      values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ), best as (
      select n, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
      from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
      group by n
    )
    select page_id, host, path, rule, coalesce(v, 'allow') as verdict
    from parts left join best using (n)
    """
)
def op6_url_rules(spark, sf_dir):
    rules = url_rules.rule_table(spark, url_rules.QUERY_RULES)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules).drop("url")


@query()
def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query()
def op8_licences(spark, sf_dir):
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["kind"] == "base")
    starts = F.transform(base, lambda f: f["first_word"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda f: f["label"]))), ",")

    certain = F.array_max(F.transform("found", lambda f: f["confidence"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(certain, F.lit(0.0)).alias("score"),
    )


@query()
def op9_one_bit_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


@query()
def op10_quality_pairs(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"), where=~quality.held_out())
    return quality.score_documents(documents, model).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


@query(
    r"""
    with words as (
      select row_number() over () as r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
      from documents
    ), sized as (
      select r, doc_id, w, len(w)::bigint as n from words where len(w) > 0
    ), whole as (
      select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sized
    ), tfs as (
      select r, doc_id, n, term, count(*)::bigint as tf
      from (select r, doc_id, n, unnest(w) as term from sized) x group by r, doc_id, n, term
    ), dfs as (
      select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as weight
      from tfs, whole group by term, n_docs
    ), asked as (
      select q, item_id, term, count(*)::bigint as times from (
        select row_number() over () as q, item_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark
      ) x group by q, item_id, term
    ), scored as (
      select q, item_id, r, doc_id, sum(times * weight
        * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
      from asked join tfs using (term) join dfs using (term), whole
      group by q, item_id, r, doc_id
    )
    select item_id, rank::integer as rank, doc_id, score from (
      select *, row_number() over (partition by q order by score desc, doc_id) as rank from scored where score > 0
    ) x where rank <= 20
    """
)
def op11_strata_search(spark, sf_dir):
    return strata.lexical_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), splice=True)


@query()
def op13_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))
