"""Selecting revisions from commit graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.operators.joins import ROWS_PER_TASK, hot_keys, join_salted
from credsieve.options import ScanOptions
from credsieve.storage import cut_lineage


class UnknownRevision(ValueError):
    """A revision named in the options does not exist."""


def numbered(commits: DataFrame) -> DataFrame:
    """commit_seq for linear histories: oldest first, ties by sha.

    Sizes are added up over the hours of a repository, then over the times of an hour and
    the first two digits of the sha, and commits are numbered within these.  So no task
    has to sort a whole repository, nor an import that gave all commits one time.
    """
    fine = ["repo", "_hour", "committed_at", "_digits"]
    parted = commits.withColumn("_hour", F.date_trunc("hour", "committed_at")).withColumn(
        "_digits", F.substring("commit_sha", 1, 2)
    )
    sizes = parted.groupBy(*fine).agg(F.count("*").alias("_n"))
    hours = sizes.groupBy("repo", "_hour").agg(F.sum("_n").alias("_n"))

    def before(by: list[str], order: list[str]):
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    offsets = hours.select("repo", "_hour", before(["repo"], ["_hour"]).alias("_hours"))
    times = sizes.select(*fine, before(["repo", "_hour"], ["committed_at", "_digits"]).alias("_times"))
    within = Window.partitionBy(*fine).orderBy("commit_sha")
    return (
        parted.join(times, fine)
        .join(offsets, ["repo", "_hour"])
        .withColumn("commit_seq", F.col("_hours") + F.col("_times") + F.row_number().over(within))
        .drop("_hour", "_digits", "_hours", "_times")
    )


def head_of(commits: DataFrame) -> DataFrame:
    """The newest commit of every repository, ties by sha: (repo, commit_sha)."""
    newest = F.max(F.struct("commit_seq", "commit_sha")).alias("c")
    return commits.groupBy("repo").agg(newest).select("repo", "c.commit_sha")


def _subtree_sizes(down: DataFrame) -> DataFrame:
    """(repo, commit_sha, size): commits whose first-parent line passes a commit, itself
    included, from (repo, commit_sha, down).

    By pointer doubling: a round adds what lies up to twice as far above, so the rounds
    are logarithmic in the longest line.  Sums are combined before the shuffle.
    """
    table = cut_lineage(down.select("repo", "commit_sha", "down", F.lit(1).cast("bigint").alias("size")))
    while not table.where(F.col("down").isNotNull()).isEmpty():
        more = (
            table.where(F.col("down").isNotNull())
            .groupBy("repo", F.col("down").alias("commit_sha"))
            .agg(F.sum("size").alias("_more"))
        )
        further = table.select("repo", F.col("commit_sha").alias("down"), F.col("down").alias("_down"))
        table = cut_lineage(
            table.join(more, ["repo", "commit_sha"], "left")
            .join(further, ["repo", "down"], "left")
            .select(
                "repo",
                "commit_sha",
                F.col("_down").alias("down"),
                (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"),
            )
        )
    return table.select("repo", "commit_sha", "size")


def _chains(commits: DataFrame) -> DataFrame:
    """Cut the graphs into first-parent chains: (repo, commit_sha, chain, height).

    Of the commits with the same first parent the one that most commits build on continues
    the parent's chain; any other one at most halves that number, so a path meets
    logarithmically many chains.  Chains are then ranked by pointer doubling: every round
    each commit looks twice as far down, so a history of a million commits takes twenty
    rounds of one join.  Pointers that are not done are all different, hence no key of
    these joins is hot.
    """
    known = commits.select("repo", F.col("commit_sha").alias("down"))
    first = commits.select("repo", "commit_sha", F.get("parents", F.lit(0)).alias("down"))
    linked = first.where(F.col("down").isNotNull()).join(known, ["repo", "down"], "left_semi")
    roots = commits.select("repo", "commit_sha").join(linked, ["repo", "commit_sha"], "left_anti")
    sizes = _subtree_sizes(linked.unionByName(roots.withColumn("down", F.lit(None).cast("string"))))
    links = (
        linked.join(sizes, ["repo", "commit_sha"])
        .groupBy("repo", "down")
        .agg(F.max(F.struct("size", "commit_sha")).alias("c"))
        .select("repo", "down", "c.commit_sha")
    )
    table = cut_lineage(
        commits.select("repo", "commit_sha")
        .join(links, ["repo", "commit_sha"], "left")
        .select(
            "repo",
            "commit_sha",
            F.coalesce("down", "commit_sha").alias("chain"),
            F.when(F.col("down").isNull(), 0).otherwise(1).cast("bigint").alias("height"),
            F.col("down").isNull().alias("done"),
        )
    )
    while not table.where(~F.col("done")).isEmpty():
        below = table.select(
            "repo",
            F.col("commit_sha").alias("chain"),
            F.col("chain").alias("_chain"),
            F.col("height").alias("_height"),
            F.col("done").alias("_done"),
        )
        further = (
            table.where(~F.col("done"))
            .join(below, ["repo", "chain"])
            .select(
                "repo",
                "commit_sha",
                F.col("_chain").alias("chain"),
                (F.col("height") + F.col("_height")).alias("height"),
                F.col("_done").alias("done"),
            )
        )
        table = cut_lineage(table.where("done").unionByName(further))
    return table.drop("done")


@dataclass(frozen=True)
class _Graph:
    """``placed`` commits on chains, ``edges`` between chains, chains with very many of both."""

    placed: DataFrame
    edges: DataFrame
    hot: DataFrame


def _graph(commits: DataFrame, rows_per_task: int) -> _Graph:
    placed = _chains(commits.select("repo", "commit_sha", "parents"))
    edges = cut_lineage(_edges(commits, placed, placed, rows_per_task))
    return _Graph(placed, edges, cut_lineage(hot_keys(edges, ["repo", "chain"], rows_per_task)))


def _edges(commits: DataFrame, own: DataFrame, placed: DataFrame, rows_per_task: int) -> DataFrame:
    """Edges from ``commits``, placed by ``own``, to other chains of ``placed``."""
    lower = placed.select(
        "repo",
        F.col("commit_sha").alias("parent"),
        F.col("chain").alias("to_chain"),
        F.col("height").alias("to_height"),
    )
    links = commits.select("repo", "commit_sha", F.explode("parents").alias("parent")).join(
        own, ["repo", "commit_sha"]
    )
    return (
        join_salted(links, lower, ["repo", "parent"], rows_per_task=rows_per_task)
        .where(F.col("chain") != F.col("to_chain"))
        .groupBy("repo", "chain", "height", "to_chain")
        .agg(F.max("to_height").alias("to_height"))
    )


def _reaches(graph: _Graph, starts: DataFrame, rows_per_task: int, extra: list[str] = ()) -> DataFrame:
    """(repo, extra, chain, reach): how far up each chain what is reachable from ``starts``
    goes, for each value of the ``extra`` columns.

    On a first-parent chain a commit reaches everything below itself, so what is
    reached of a chain is one number.  Only the other edges need following, and a round
    follows all of them at once: the number of rounds is the number of chains a path
    has to pass, not the depth of the history.
    """
    keys = ["repo", *extra, "chain"]
    reached = cut_lineage(
        starts.select("repo", "commit_sha", *extra)
        .join(graph.placed, ["repo", "commit_sha"])
        .groupBy(*keys)
        .agg(F.max("height").alias("reach"))
    )
    grown = reached
    while True:
        onward = (
            join_salted(graph.edges, grown, ["repo", "chain"], hot=graph.hot)
            .where(F.col("height") <= F.col("reach"))
            .groupBy("repo", *extra, F.col("to_chain").alias("chain"))
            .agg(F.max("to_height").alias("reach"))
        )
        before = reached.withColumnRenamed("reach", "_reach")
        grown = cut_lineage(
            onward.join(before, keys, "left")
            .where(F.col("_reach").isNull() | (F.col("reach") > F.col("_reach")))
            .select(*keys, "reach")
        )
        if grown.isEmpty():
            return reached
        reached = cut_lineage(reached.unionByName(grown).groupBy(*keys).agg(F.max("reach").alias("reach")))


def _reached(graph: _Graph, starts: DataFrame, rows_per_task: int) -> DataFrame:
    """(repo, commit_sha) of all commits reachable from ``starts``, these included."""
    reached = _reaches(graph, starts, rows_per_task)
    return (
        join_salted(graph.placed, reached, ["repo", "chain"], rows_per_task=rows_per_task)
        .where(F.col("height") <= F.col("reach"))
        .select("repo", "commit_sha")
    )


def ancestors(
    commits: DataFrame, starts: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """(repo, commit_sha) of ``starts`` and everything they descend from."""
    return _reached(_graph(commits, rows_per_task), starts, rows_per_task)


def commit_range(
    commits: DataFrame,
    base: str | DataFrame,
    head: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Commits reachable from the head but not from ``base``.

    ``base`` is a sha, or (repo, commit_sha) rows to cut several repositories at once.
    """
    if isinstance(base, str):
        bases = commits.where(F.col("commit_sha") == base).select("repo", "commit_sha")
        if bases.isEmpty():
            raise UnknownRevision(f"unknown base revision {base!r}")
        # a handful of repositories at most hold one sha
        commits = commits.join(F.broadcast(bases.select("repo").distinct()), "repo", "left_semi")
    else:
        bases = base.select("repo", "commit_sha")
        missing = bases.join(commits, ["repo", "commit_sha"], "left_anti").first()
        if missing:
            raise UnknownRevision(f"unknown base revision {missing.commit_sha!r}")
    head = head_of(commits) if head is None else head
    graph = _graph(commits, rows_per_task)
    wanted = _reached(graph, head, rows_per_task).join(
        _reached(graph, bases, rows_per_task), ["repo", "commit_sha"], "left_anti"
    )
    return commits.join(wanted, ["repo", "commit_sha"], "left_semi")


def select_commits(
    commits: DataFrame, options: ScanOptions, head: DataFrame | None = None
) -> DataFrame:
    """Commits to scan: the head alone, a range, or all; head_only wins over ranges."""
    if options.head_only:
        head = head_of(commits) if head is None else head
        return commits.join(head, ["repo", "commit_sha"], "left_semi")
    base = options.diff_base or options.since_commit
    return commit_range(commits, base, head) if base else commits


def snapshot_at(
    commits: DataFrame, file_versions: DataFrame, head: DataFrame | None = None
) -> DataFrame:
    """The tree of the head: the last version of each path on its first-parent line."""
    head = head_of(commits) if head is None else head
    line = ancestors(commits.withColumn("parents", F.slice("parents", 1, 1)), head)
    on_line = commits.join(line, ["repo", "commit_sha"], "left_semi").select(
        "repo", "commit_sha", "commit_seq"
    )
    last = F.max(F.struct("commit_seq", "commit_sha", "blob_sha", "change_type")).alias("v")
    return (
        join_salted(file_versions, on_line, ["repo", "commit_sha"])
        .groupBy("repo", "path")
        .agg(last)
        .where(F.col("v.change_type") != "D")
        .select("repo", "path", "v.blob_sha")
    )
