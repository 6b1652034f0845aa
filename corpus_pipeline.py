"""A training corpus from ``documents``: five stages of ironsieve.llm, each over all that the one before has kept.

Every stage is written to Parquet and read again: its result is whole before the next begins, and a lost executor costs
no more than its stage. All but the last return the columns of ``documents``, and any others that the input has. What a
stage no longer needs is deleted when the next one has been written.

Nulls, empty and repeated rows: see each stage. An empty table passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironsieve.llm.decontamination import drop_leaks
from ironsieve.llm.jaccard_join import jaccard_components
from ironsieve.llm.mixing import mix_sources
from ironsieve.llm.quality import keep_good, train_on_folds
from ironsieve.llm.secret_scan import redact_secrets
from ironsieve.session import delete_folder, ensure_checkpoint_dir, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text has the score of a text without features, and stays if that is 0.5 or more; a null doc_id is
    scored like any other; repeated rows go or stay together.
    """
    return keep_good(docs, train_on_folds(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the smallest doc_id stays.

    Rows that repeat a doc_id with equal texts are one row afterwards; a null doc_id is kept, as nothing links with it,
    as are null texts and texts without words.
    """
    parts = jaccard_components(docs, k=5, percent=80)
    gone = parts.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # rows that repeat an id meet again here; only they need comparing
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionAll(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null and empty texts leak nothing; rows without doc_id are judged like others; repeated rows go or stay together.
    """
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` follows; every row stays, null and empty texts as they are."""
    return redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, taken) of the documents that the mix takes, wholly or in part, once or repeatedly.

    Texts without words have size 0 and are not taken; null sources are a source of their own, the last; null doc_ids
    share one place in the order; repeated rows count as often as they stand.
    """
    mixed = mix_sources(docs, (5, 2, 1), (3, 2), 2)
    return mixed.where("taken > 0").select("doc_id", "source", "size", "taken")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]

#: Training and pattern novelty have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder, last = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if last:
            delete_folder(spark, last)
        docs, last = spark.read.parquet(out), out
    return docs
