"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, the
last one the packed pieces.  Toxic documents go, one document of each
near-duplicate group stays, documents with benchmark passages go, secrets are
masked, and what is left is packed.  A filtering stage keeps every document its
operator does not reject, with all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacksmith.llm import decontam, jaccard, packing, secrets, toxicity
from stacksmith.llm.shared import table, written


#: Rows that Spark hands to a Python worker at once; whole documents are long, so fewer than its default.
ARROW_ROWS = "1024"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that score 0.5 or more go."""
    _small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 on five-word shingles at a similarity of 0.8: the smallest id of each group stays."""
    _small_batches(spark)
    return jaccard.keep_one(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a benchmark window go."""
    _small_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets are masked, no document goes; n_chars follows the masked text."""
    _small_batches(spark)
    spans = secrets.unused(docs, "spans")
    found = secrets.find_secrets(docs, out=spans)
    if "n_chars" in docs.columns:
        flag = secrets.unused(found, "__masked")
        masked = secrets.redact(found.withColumn(flag, F.size(spans) > 0), spans=spans)
        length = F.when(F.col(flag), F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return masked.withColumn("n_chars", length).select(docs.columns)
    return secrets.redact(found, spans=spans).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    _small_batches(spark)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The stages fit models and token ids, which SQL cannot express; tests compare them with plain-Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
