"""What the operators share: reading, row keys and hash remainders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, text): null texts are empty, other columns are left behind.

    (doc_id, text_key) stands for a row in joins.  Rows that repeat both are equal rows
    and share their result, so repeated ids and null ids need no numbering.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))


def attach(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Left join of ``found`` (one row per (doc_id, text_key) at most) to ``rows``."""
    right = found.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    return rows.join(right, on, "left").drop("_doc_id", "_text_key")


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): the union of the [lo, hi) spans of each key as its maximal runs.

    A running maximum over the spans in order, so linear in their number after the sort.
    """
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(reach, F.col("lo") - 1) < F.col("lo"), 1).otherwise(0)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
