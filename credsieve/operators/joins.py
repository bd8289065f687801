"""Equi joins in which a few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def hot_keys(many: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task should get, and into how many parts to cut them.

    The count is combined before the shuffle.  At most rows / rows_per_task keys can
    qualify, which is what makes the result safe to broadcast.
    """
    return (
        many.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > rows_per_task)
        .select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))
    )


def join_salted(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join on ``keys`` where single keys of ``many`` may be too large for a task.

    Rows of a hot key are dealt over as many parts as its size asks for, and the rows
    of ``few`` with that key are repeated once per part; all other keys stay as they
    are.  ``how`` may be inner, left, left_semi or left_anti.
    """
    hot = F.broadcast(hot_keys(many, keys, rows_per_task) if hot is None else hot)
    others = [c for c in many.columns if c not in keys] or keys
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = (
        many.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*others), parts).cast("int"))
        .drop("_parts")
    )
    repeated = (
        few.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
