"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import (
    conversations,
    decontamination,
    html_extraction,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    spelling,
    substring_dedup,
    suffix_dedup,
    url_filter,
    warc,
)
from sievework.llm.oracle import conversations_sql, repeats_sql, spelling_sql, substrings_sql, url_sql
from sievework.llm.url_filter import Rule

# The URL rules, and globs for hosts and paths of link farms.
URL_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
URL_BLOCKED = ("*spam*/*", "*pills*/*", "*casino*/*", "*viagra*/*", "*/wp-login*", "*/*.exe")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], texts=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "failed_rules")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = warc.derive(warc.responses(table(spark, sf_dir, "pages")).select("page_id", "headers", "block"))
    names = {
        "warc_type": "WARC-Type",
        "record_id": "WARC-Record-ID",
        "refers_to": "WARC-Refers-To",
        "target_uri": "WARC-Target-URI",
        "payload_digest": "WARC-Source-Payload-Digest",
        "block_digest": "WARC-Block-Digest",
    }
    return derived.select("page_id", *[warc.header(h).alias(n) for n, h in names.items()], F.decode("block", "UTF-8").alias("block"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES, URL_BLOCKED).select("page_id", "host", "path", "rule", "verdict")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "distance", "start", "n_words")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"], shingle=3, radius=2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summaries(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], bodies=False)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_best_fit_packing,
        op3_pii,
        op4_histogram_shards,
        op5_substring_dedup,
        op6_quality_rules,
        op7_warc_derivatives,
        op8_url_filter,
        op9_decontamination,
        op10_simhash,
        op11_conversation_repair,
        op12_suffix_array_dedup,
        op13_spelling_variants,
    )
}
# The globs above as one expression; a star left of the first slash does not cross one.
_BLOCKED = r"(?s)[^/]*(spam|pills|casino|viagra)[^/]*/.*|[^/]*/wp-login.*|[^/]*/.*\.exe"
ORACLES: dict[str, str] = {
    "op5_substring_dedup": repeats_sql(13),
    "op11_conversation_repair": conversations_sql(),
    "op12_suffix_array_dedup": substrings_sql(400),
    "op13_spelling_variants": spelling_sql(),
    "op8_url_filter": url_sql(URL_RULES, _BLOCKED),
}
