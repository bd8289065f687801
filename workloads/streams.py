"""Streaming runs over the conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.options import ScanOptions
from credsieve.plans.scan import scan_texts
from credsieve.storage import cut_lineage, work_folder
from credsieve.streaming.scan import run_incremental, stream_findings, stream_history
from workloads import planted


# Batches of a stream.
BATCHES = 4
# Files of a batch for each core: a file is the least that a task reads.
FILES_PER_CORE = 2


def _arriving(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """The rows, dealt by key to the files of a few batches, as a stream."""
    spark = rows.sparkSession
    files = FILES_PER_CORE * spark.sparkContext.defaultParallelism
    rows.repartition(BATCHES * files, key).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, text, committed_at, commit_seq) as a stream.

    The table is dealt by conversation to files, some of which are a batch.
    """
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    _arriving(table, "conv_id", f"{_folder(spark)}/arriving").createOrReplaceTempView("conversations")
    # one hour per conversation, one minute per turn, some time after the epoch
    hour = F.substr("repo", F.lit(5)).cast("bigint")
    return planted.with_blob(spark).select(
        "repo",
        F.concat(F.lit("turn"), (F.col("turn") % 3).cast("string"), F.lit(".txt")).alias("path"),
        "text",
        F.timestamp_seconds(F.lit(1_700_000_000) + hour * 3600 + F.col("turn") * 60).alias("committed_at"),
        F.col("turn").alias("commit_seq"),
    )


def _folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/{uuid.uuid4().hex}"


def stream_conversations(
    spark: SparkSession, sf_dir: str, options: ScanOptions | None = None, baseline: DataFrame | None = None
) -> DataFrame:
    """Scan the conversations as a stream until all is read; the findings written."""
    folder = _folder(spark)
    # batches come by conversation, not by time: the horizon is longer than the table
    found = stream_findings(_turns(spark, sf_dir), horizon="36500 days", options=options, baseline=baseline)
    query = (
        found.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/findings")
    )
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/findings")


def stream_two_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as two streams: versions by conversation, contents by their hash."""
    folder = _folder(spark)
    turns = cut_lineage(planted.turns(spark, sf_dir))
    hour = F.substr("repo", F.lit(5)).cast("bigint")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + hour * 3600 + F.col("turn") * 60)
    versions = turns.select(
        "repo", F.concat(F.lit("turn"), (F.col("turn") % 3).cast("string"), F.lit(".txt")).alias("path"), "blob_sha",
        at.alias("committed_at"), F.col("turn").cast("bigint").alias("commit_seq"),
    )
    contents = turns.groupBy("blob_sha").agg(F.first("text").alias("text"), F.max(at).alias("arrived_at"))
    sides = [_arriving(versions, "repo", f"{folder}/versions"), _arriving(contents, "blob_sha", f"{folder}/contents")]
    found = stream_history(*sides, horizon="36500 days", salts=2)
    query = (
        found.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/findings")
    )
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/findings")


def known_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline of the findings of the same turns whose fingerprint starts with 0 to 7."""
    turn = F.concat(F.lit("turn"), (F.col("turn") % 3).cast("string"), F.lit(".txt"))
    texts = planted.turns(spark, sf_dir).select("repo", turn.alias("path"), "text", F.col("turn").alias("commit_seq"))
    found = scan_texts(texts).where("fingerprint < '8'").select("repo", "fingerprint").distinct()
    return cut_lineage(found)


def incremental_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a baseline that is rolled forward batch by batch."""
    folder = _folder(spark)
    run_incremental(
        _turns(spark, sf_dir), f"{folder}/findings", f"{folder}/baseline", f"{folder}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/findings")
