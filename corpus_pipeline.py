"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before it wrote: toxic documents go, superfluous lines go, one document of each group of near
copies stays, personal data is masked, and what is left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import line_dedup, minhash, packing, pii, toxicity
from lumenfold.llm.shared import drop, table, tidy, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOXIC = 0.3


def recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where there is one, of the texts as they are now (null for null texts)."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score is below ``TOXIC``; the model learns from all labels of documents that came here.

    Each row is judged by its own text, so null ids, repeated rows and several texts under one id do not touch one another. Null
    and empty texts have the base rate as score and stay unless most labels are toxic. All columns stay, whatever their names; no rows give no rows.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), TOXIC)


def without_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, less the lines that earlier ones have (smaller doc_id, null last; ties by the texts' hashes).

    Rows equal in doc_id and text are one document and lose the same lines. Texts may become empty; null texts stay null. All columns stay, whatever
    their names; no rows give no rows.
    """
    return recounted(line_dedup.without_repeated_lines(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, at five words and a similarity of 0.8: the one with the smallest doc_id (null last; ties by hash).

    Rows are told apart by doc_id and text, so another text under an id that goes stays; of rows equal in both one stays. Texts without words, null
    ones included, are near nothing and all stay. All columns stay, whatever their names; no rows give no rows.
    """
    return minhash.without_near_duplicates(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data masked by its kind, as in <EMAIL>.

    Equal texts get the same result, whatever their ids; null and empty texts stay as they are. All columns stay, whatever their names; no rows give
    no rows.
    """
    return recounted(pii.mask(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and their places in sequences of 2048 tokens.

    Null and empty texts are one piece of the end alone; long ones are cut; repeated rows and null ids are packed like others; no rows give no rows.
    """
    return packing.pack(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("toxicity", without_toxic), ("line-dedup", without_lines), ("minhash-near-dedup", without_near_copies), ("pii", without_personal_data), ("packing", packed)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes; the tables of a stage go as soon as the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, tidy(lambda: written(stage(spark, docs, sf_dir), name))()  # noqa: B023  called at once
        drop(before)
    return docs
