"""Training-data pipeline over `documents`: every stage reads what the stage before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import crf, ledger, mixture, packing, shingles
from cohortloom.session import materialise, ship_package

#: Repetitions of the whole corpus that the mixture aims at.
EPOCHS = 2.0
#: Jaccard similarity of five-word shingles from which two texts are near copies.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the web policy rejects."""
    # The row travels as one struct, so measurements never meet columns of the same name.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text")
    judged = ledger.build_ledger(rows)
    return judged.where(ledger.passes(ledger.mask_of(ledger.policy_named("web")))).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash in covering tables, with MinHash for recall, proposes links; each is checked on five-word shingles."""
    ship_package(spark)
    return shingles.keep_one(docs, threshold=SIMILARITY).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    ship_package(spark)
    return crf.mask(docs, crf.fit(crf.labelled_table(spark))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated toward the square-root weights of their sources, in random order."""
    return mixture.mix(docs, epochs=EPOCHS).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("personal data", personal_data),
    ("mixture", mixing),
    ("packing", packed),
]

#: Fingerprints, the random field and the tokenizer are beyond SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
