"""The corpus pipeline: documents to packed sequences in five written stages.

Defined results: a null, empty or very short text has no language near it and leaves at the
first stage; of equal texts, whatever their ids, one document stays; rows that repeat an id
and a text are judged alike, of them the second stage keeps one; a very long text passes
every stage in one piece; an empty table gives no pieces.  Columns beside those of documents
stay as they are up to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.llm import decontaminate, langid, packing, simhash, suffix
from credsieve.llm.common import remainder, table
from credsieve.storage import delete, work_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of some language; the model is learnt from the documents."""
    model = langid.fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    return langid.drop_unknown(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.keep_one_of_each(docs)


# Passages of some fifty words take 230 bytes and more; what is shorter than this, such as
# a sentence that many texts have, stays.
PASSAGE, PASSAGE_GRAM = 200, 60


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that an earlier text, or an earlier place of the
    same one, has; n_chars, where there is one, follows the text."""
    cut = suffix.remove_repeats(docs, PASSAGE, PASSAGE_GRAM, keep_first=True)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids."""
    pieces = packing.pack(docs)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packed),
]

# Models, components of graphs and tokenisers are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    A stage's files go when the next one is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
