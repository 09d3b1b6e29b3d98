"""A corpus pipeline over documents: toxicity, near duplicates, benchmark passages, personal data, token ids.

Each stage takes what its predecessor kept, works on all of it, and its decisions take effect. All but the
last return the columns of documents. The last returns doc_id, lang, source, ids and n_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontam, pieces, pii, simhash, toxicity
from logloom.llm.common import stored, table

SIMILARITY = 0.8  # Jaccard, of the sets of five-word shingles
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of an Arrow batch. Whole texts go to Python, and Python workers live on from stage to stage with the memory of their largest batch.
BATCH_ROWS = 1000


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; null and empty texts stay. The model is fitted on labelled documents."""
    _bound_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates, linked by SIMILARITY of shingles of five words; documents without a doc_id stay."""
    _bound_batches(spark)
    return simhash.drop_near_duplicates(docs.select(*COLUMNS), words=5, similarity=SIMILARITY)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and documents without a doc_id stay."""
    _bound_batches(spark)
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts put in general terms; n_chars follows the text. Null texts stay null."""
    _bound_batches(spark)
    return pii.sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids that decode to their texts; null and empty texts have none."""
    _bound_batches(spark)
    rows = pieces.encode(docs.select(*COLUMNS), pieces.vocabulary(spark), keep=("doc_id", "lang", "source"))
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("decontamination", drop_benchmark), ("pii", sanitise), ("encode", encode)]

#: The stages' models and fingerprints are beyond SQL; tests/llm/test_pipeline_plain.py holds them all against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on documents, each stage's rows written in the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
