"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lexaxis.llm import exact_dedup, langid, licenses, line_dedup, packing, pieces, sharding, simhash, topk, warc

#: A SentencePiece model of merge type; a parameter of pieces.encode() and the others there.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_docs(spark, sf_dir), MODEL)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.replay(_docs(spark, sf_dir)).select("doc_id", "text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return topk.search(docs, docs.where("doc_id % 50 = 0"), query_id="doc_id")


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_docs(spark, sf_dir))


def op9_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_duplicates,
        op2_best_fit_packing,
        op3_warc_round_trip,
        op4_sentencepiece,
        op5_line_dedup,
        op6_language_id,
        op7_top_k_search,
        op8_exact_duplicates,
        op9_range_shards,
        op10_license_scan,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op3_warc_round_trip": "select page_id, url, html, 'sha256:' || sha256(coalesce(html, '')) as digest from pages",
    "op5_line_dedup": """
        with d as (select doc_id, text, case when doc_id % 10 = 0 then 3 when coalesce(doc_id % 2, 0) = 0 then 0 else 1 end as batch from documents),
        l as (select doc_id, batch, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
        r as (select *, trim(line, ' ') = '' as blank, row_number() over (partition by line order by batch, doc_id, i) as n from l)
        select doc_id, string_agg(line, chr(10) order by i) filter (blank or n = 1) as text from r
        group by doc_id having bool_or(not blank and n = 1) or bool_and(blank)
        union all select doc_id, text from documents where text is null""",
    "op7_top_k_search": topk.oracle(),
    "op8_exact_duplicates": "select doc_id, duplicate_of from (select doc_id, min(doc_id) over (partition by text) as duplicate_of from documents where text is not null) where doc_id <> duplicate_of",
    "op9_range_shards": sharding.oracle(),
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
