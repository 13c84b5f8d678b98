"""A training corpus from raw documents: four stages, each on all that the one before has kept.

Toxic documents go, one document of each group of near duplicates stays, personal data is masked, and what is left is
packed into sequences. A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's docs; all but the last return the columns of documents.

Defined results, for every stage: null and empty texts pass as they are (packed as one end token); rows without an id are
kept; of equal rows all stay or go, and near duplicates are judged by id, so rows repeated under one id stay; columns of
other names pass through; an empty table gives an empty one; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.llm import minhash, packing, pii, toxicity
from atomweave.llm.common import cut, remove, shared_dir, table
from atomweave.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.7 or more under a network learned from the labels outside fold 1."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), where=toxicity.fold("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, net, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, 0.8): the one of least id."""
    return minhash.drop_duplicates(docs, size=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets as [KIND]; n_chars follows the text."""
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, as op9 returns them."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", mask_personal_data), ("packing", pack)]

#: The first stage is a trained network, which SQL doesn't express; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables between stages go as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            path = shared_dir(spark)
            docs = cut(docs, path)
            if before:
                remove(spark, before)
            before = path
    return docs
