"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays,
repeated passages and secrets are taken out of the texts, and what is left is packed.

Each stage takes (spark, docs, sf_dir), where docs is all that its predecessor kept, and
all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.llm import minhash, pack, secrets, substring, toxicity
from prismtab.llm.common import cut, row_key, small_batches, table


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier predicts to be toxic."""
    small_batches(spark)
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, True, ("__score", "__predicted")).filter("__predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group linked by 0.8 of their five-word shingles. Of equal rows one stays."""
    small_batches(spark)
    # Cut once: a row for each row that stays, known by its doc_id and 64 bits of doc_id and text.
    kept = cut(minhash.clustered(docs, 5, 0.8).filter("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk")))
    once = kept.distinct()
    same = (F.col("__key") == F.col("__rk")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    rows = docs.withColumn("__key", row_key("doc_id", "text")).join(once.hint("shuffle_hash"), same, "left_semi")
    if kept.count() != once.count():
        rows = rows.dropDuplicates(["doc_id", "__key"])
    return rows.select(*docs.columns)


def repeated_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that a window of 20 covers which also starts earlier."""
    small_batches(spark)
    out = substring.deduplicated(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def secrets_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by a mark."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces, with their sequences."""
    small_batches(spark)
    return pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("MinHash near-dedup", one_of_each_group),
    ("substring dedup", repeated_passages_go),
    ("secret scans", secrets_go),
    ("best-fit packing", packed),
]
#: SQL can't express a fitted classifier or a tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
