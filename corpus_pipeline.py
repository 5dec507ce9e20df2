"""A training corpus from documents: toxicity, near-duplicates, personal data, mixing to target weights, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the shared folder and reads back as the next stage's docs. All stages but the last keep the columns of
documents. Empty tables, null texts and repeated rows pass through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociframe.llm import minhash, mixing, packing, pii, toxicity
from lociframe.llm.tables import small_batches, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates (five-word shingles); repeated rows of it once."""
    return minhash.without_near_duplicates(docs, words=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found personal data replaced by its kind; n_chars follows the text."""
    small_batches(spark)
    return pii.without_pii(docs, pii.train())


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target weights of good and low-quality text; all good text stays."""
    model = mixing.train(docs, table(spark, sf_dir, "labels"), mixing.quality_domain())
    return mixing.thinned(docs, model, mixing.QUALITY_WEIGHTS, whole="good")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_to_targets),
    ("packing", pack),
]

#: Learnt models and tokenizers are beyond SQL; tests compare what each stage keeps with its operator and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
