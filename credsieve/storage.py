"""Cutting lineage so that it survives lost executors, and giving the space back."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    A local session without that setting works in its warehouse folder and removes what
    it wrote there at its end; on a cluster the setting is required.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work-{context.applicationId}"
        atexit.register(shutil.rmtree, folder.removeprefix("file:"), ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table into the shared work folder and go on from there.

    It is computed once, a lost executor does not bring the computation back, and the
    optimizer knows its size afterwards.
    """
    path = f"{lineage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lineage_folder(spark: SparkSession) -> str:
    """Where this application cuts lineage."""
    return f"{work_folder(spark)}/lineage-{spark.sparkContext.applicationId}"


_databases: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete what ``cut_lineage`` and ``Steps`` of this application have written.

    To be called when all results are read; they may hold values in clear text.
    """
    while _databases:
        spark.sql(f"DROP DATABASE IF EXISTS {_databases.pop()} CASCADE")
    delete(spark, lineage_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, whatever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


# Frees the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps:
    """Written steps of one job, each dropped as soon as the job no longer reads it.

    They are managed tables of a database placed in the shared work folder, so that
    dropping one deletes its files, whatever file system the folder is on.  The shuffle
    files of a step are freed once it is written: nothing reads them again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.database = f"steps_{uuid.uuid4().hex}"
        place = f"{work_folder(spark)}/{self.database}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{place}'")
        _databases.append(self.database)
        self._made = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._made += 1
        name = f"{self.database}.step_{self._made}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.format("parquet").saveAsTable(name)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        table = self.spark.table(name)
        table._step = name
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``write`` returned."""
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table._step}")
