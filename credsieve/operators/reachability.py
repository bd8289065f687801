"""A reachability index of commit graphs that is kept and extended.

The index holds the place of each commit on a first-parent chain and the edges between
chains (see ``history``).  New commits never change what is there: they lengthen a chain at
its top, or begin a new one.  So an extension reads the tops of the chains, places the new
commits and appends; a question about many ranges of many repositories is one job over
chains, whose answer for a chain is two numbers.

Layout: ``edges/batch=<n>`` and then ``placed/batch=<n>``, whose presence commits the batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.operators.history import UnknownRevision, _chains, _edges, _Graph, _reaches
from credsieve.operators.joins import ROWS_PER_TASK, hot_keys, join_salted
from credsieve.storage import cut_lineage

PLACED = "repo string, commit_sha string, chain string, height bigint"
EDGES = "repo string, chain string, height bigint, to_chain string, to_height bigint"


class CommitIndex:
    """The index below ``path``, on storage that all executors share."""

    def __init__(self, spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> None:
        self.spark, self.path, self.rows_per_task = spark, path, rows_per_task

    def _read(self, kind: str, schema: str) -> DataFrame:
        schema += ", batch int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except AnalysisException as exc:
            if not (exc.getCondition() or "").startswith("PATH_NOT_FOUND"):
                raise
            return self.spark.createDataFrame([], schema)

    def placed(self) -> DataFrame:
        """(repo, commit_sha, chain, height) of all commits."""
        return self._read("placed", PLACED).drop("batch")

    def edges(self) -> DataFrame:
        """(repo, chain, height, to_chain, to_height) between chains."""
        committed = self._read("placed", PLACED).select("batch").distinct()
        return self._read("edges", EDGES).join(F.broadcast(committed), "batch", "left_semi").drop("batch")

    def extend(self, commits: DataFrame) -> int:
        """Add the commits (repo, commit_sha, parents) that are new; their parents are known
        or come along, unless the history is cut off there.  Returns how many were new."""
        known = cut_lineage(self.placed())
        new = cut_lineage(
            commits.select("repo", "commit_sha", "parents")
            .dropDuplicates(["repo", "commit_sha"])
            .join(known.select("repo", "commit_sha"), ["repo", "commit_sha"], "left_anti")
        )
        count = new.count()
        if not count:
            return 0
        own = _chains(new)
        # chains that begin at a commit whose first parent is the top of a known chain
        tops = known.groupBy("repo", "chain").agg(F.max(F.struct("height", "commit_sha")).alias("t")).select(
            "repo", F.col("t.commit_sha").alias("parent"), F.col("chain").alias("_onto"), (F.col("t.height") + 1).alias("_from")
        )
        bottoms = new.select("repo", F.col("commit_sha").alias("chain"), F.get("parents", F.lit(0)).alias("parent"))
        lengths = own.groupBy("repo", "chain").agg(F.count("*").alias("n"))
        # of several chains above one top the longest goes on with it
        onto = (
            bottoms.join(tops, ["repo", "parent"])
            .join(lengths, ["repo", "chain"])
            .groupBy("repo", "_onto", "_from")
            .agg(F.max(F.struct("n", "chain")).alias("c"))
            .select("repo", F.col("c.chain").alias("chain"), "_onto", "_from")
        )
        own = cut_lineage(
            own.join(onto, ["repo", "chain"], "left").select(
                "repo", "commit_sha", F.coalesce("_onto", "chain").alias("chain"), (F.col("height") + F.coalesce("_from", F.lit(0))).alias("height")
            )
        )
        batch = (self._read("placed", PLACED).agg(F.max("batch")).head()[0] or 0) + 1
        edges = _edges(new, own, known.unionByName(own), self.rows_per_task)
        edges.write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch}")
        own.write.parquet(f"{self.path}/placed/batch={batch}")
        return count

    def ranges(self, asked: DataFrame) -> DataFrame:
        """(repo, range_id, commit_sha) reachable from a head and not from its base.

        ``asked`` holds (repo, range_id, base, head); a null base excludes nothing.  Any
        number of ranges of a repository are answered together.
        """
        asked = cut_lineage(asked.select("repo", "range_id", "base", "head"))
        placed = cut_lineage(self.placed())
        named = asked.select("repo", F.explode(F.array("base", "head")).alias("commit_sha")).where("commit_sha IS NOT NULL")
        unknown = named.join(placed, ["repo", "commit_sha"], "left_anti").limit(3).collect()
        if unknown:
            raise UnknownRevision(", ".join(f"{r.repo}: {r.commit_sha}" for r in unknown))
        edges = cut_lineage(self.edges())
        graph = _Graph(placed, edges, cut_lineage(hot_keys(edges, ["repo", "chain"], self.rows_per_task)))
        starts = asked.select("repo", "range_id", F.lit(True).alias("is_head"), F.col("head").alias("commit_sha")).unionByName(
            asked.where("base IS NOT NULL").select("repo", "range_id", F.lit(False).alias("is_head"), F.col("base").alias("commit_sha"))
        )
        reached = _reaches(graph, starts, self.rows_per_task, ["range_id", "is_head"])
        spans = reached.groupBy("repo", "range_id", "chain").agg(
            F.max(F.when(F.col("is_head"), F.col("reach"))).alias("_to"),
            F.coalesce(F.max(F.when(~F.col("is_head"), F.col("reach"))), F.lit(-1)).alias("_after"),
        )
        # chains of which the base has all that the head has go no further
        spans = spans.where(F.col("_to") > F.col("_after"))
        return (
            join_salted(placed, spans, ["repo", "chain"], rows_per_task=self.rows_per_task)
            .where((F.col("height") > F.col("_after")) & (F.col("height") <= F.col("_to")))
            .select("repo", "range_id", "commit_sha")
        )
