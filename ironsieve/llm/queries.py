"""The registered queries of this subpackage. Their SQL, where SQL can express them, is in ironsieve.llm.sql."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironsieve.llm.conversation_trie import conversation_trie
from ironsieve.llm.decontamination import leaked_items
from ironsieve.llm.embedding_dedup import near_duplicate_vectors
from ironsieve.llm.fertility import fertility_rules
from ironsieve.llm.html_extract import extract_main_text
from ironsieve.llm.jaccard_join import jaccard_components
from ironsieve.llm import language_id
from ironsieve.llm.mixing import mix_sources
from ironsieve.llm.quality import quality_scores, train_on_folds
from ironsieve.llm.secret_scan import scan_secrets
from ironsieve.llm.sql import SQL
from ironsieve.llm.url_filter import filter_urls
from ironsieve.llm.vector_codes import vector_codes
from ironsieve.llm.warc import read_archives, write_archives
from ironsieve.session import ensure_checkpoint_dir, read_table

URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), 0.98)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES).drop("component")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(read_table(spark, sf_dir, "documents"), (5, 2, 1), (3, 2), 2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_scores(docs, train_on_folds(docs, read_table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.predict_languages(docs, language_id.train_on_folds(docs))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(read_table(spark, sf_dir, "pages"), folder)
    back = read_archives(index, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op11_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(read_table(spark, sf_dir, "documents")).drop("measures")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings")).drop("label")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations")).drop("node", "parent")


QUERIES = (
    op1_embedding_dedup,
    op2_url_filter,
    op3_source_mixing,
    op4_decontamination,
    op5_quality,
    op6_language_id,
    op7_warc_bundles,
    op8_html_extraction,
    op9_ngram_jaccard,
    op10_secret_scan,
    op11_fertility_rules,
    op12_vector_codes,
    op13_conversation_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
