"""Tables of file contents."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.options import MAX_FILE_SIZE, SNIFFED_BYTES, ScanOptions


def is_binary(content: Column) -> Column:
    """A NUL byte near the start marks binary content."""
    return F.contains(F.substring(content, 1, SNIFFED_BYTES), F.lit(bytearray(b"\x00")))


def decoded(content: Column) -> Column:
    """UTF-8 text; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def is_readable(blobs: DataFrame, options: ScanOptions) -> Column:
    """Not too large and not binary.

    Stored ``size`` and ``is_binary`` columns are used where a table has them, so that
    questions about readability alone need not read contents.
    """
    size = F.col("size") if "size" in blobs.columns else F.octet_length("content")
    binary = F.col("is_binary") if "is_binary" in blobs.columns else is_binary(F.col("content"))
    return (size <= options.max_file_size) & ~binary


def is_text(text: Column, options: ScanOptions) -> Column:
    """The same of a ready text."""
    return (F.octet_length(text) <= options.max_file_size) & ~is_binary(text.cast("binary"))


def readable_texts(blobs: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """(blob_sha, text) of the contents worth scanning.

    A blobs table may hold ``content`` bytes or ready ``text``.
    """
    options = options or ScanOptions()
    if "content" not in blobs.columns:
        return blobs.where(is_text(F.col("text"), options)).select("blob_sha", "text")
    return blobs.where(is_readable(blobs, options)).select(
        "blob_sha", decoded(F.col("content")).alias("text")
    )


def read_folder(
    spark: SparkSession, path: str, repo: str = "", max_file_size: int = MAX_FILE_SIZE
) -> DataFrame:
    """Files below a folder as (repo, path, blob_sha, size, is_binary, content).

    The size limit reaches the source, which then does not read larger files.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .where(F.col("length") <= max_file_size)
    )
    if "://" not in path and not path.startswith(("/", "file:")):
        path = os.path.abspath(path)
    # the source writes file:/a for a folder given as /a or file:///a
    root = re.sub("^file:/*", "/", path).rstrip("/") + "/"
    # the root comes first in a path, folders of the same name come later
    below = F.locate(root, F.col("path")) + len(root)
    return files.select(
        F.lit(repo).alias("repo"),
        F.substr(F.col("path"), below).alias("path"),
        F.sha2("content", 256).alias("blob_sha"),
        F.col("length").alias("size"),
        is_binary(F.col("content")).alias("is_binary"),
        "content",
    )


def save_blobs(blobs: DataFrame, table: str, buckets: int = 1024) -> None:
    """Write a blobs table bucketed by blob_sha.

    Selecting a part of such a table by blob_sha needs no shuffle of contents.
    """
    (
        blobs.withColumn("size", F.octet_length("content").cast("bigint"))
        .withColumn("is_binary", is_binary(F.col("content")))
        .write.bucketBy(buckets, "blob_sha")
        .sortBy("blob_sha")
        .mode("overwrite")
        .saveAsTable(table)
    )
