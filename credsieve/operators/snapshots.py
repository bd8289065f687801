"""What changed between two states of a tree of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.operators.joins import ROWS_PER_TASK, join_salted
from credsieve.storage import cut_lineage


def snapshot_diff(
    new: DataFrame,
    old: DataFrame,
    keys: list[str] = ("repo",),
    with_deleted: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Changes from ``old`` to ``new``, both (keys, path, blob_sha).

    change_type: M changed content under a known path, R content of a path that is
    gone, C content that is still in the old tree elsewhere, A anything else, and D
    for paths that are gone if asked for.  ``keys`` pair the trees, for instance by
    repository, or by repository and commit.
    """
    keys = list(keys)
    tree = [*keys, "path", "blob_sha"]
    changed = new.select(*tree).join(old.select(*tree), tree, "left_anti")
    gone = old.select(*tree).join(new.select(*keys, "path"), [*keys, "path"], "left_anti")
    known_paths = old.select(*keys, "path").withColumn("_known", F.lit(True))
    # one row per content, so that content with many copies costs one row
    contents = (
        old.select(*keys, "blob_sha", F.lit(False).alias("_gone"))
        .unionByName(gone.select(*keys, "blob_sha", F.lit(True).alias("_gone")))
        .groupBy(*keys, "blob_sha")
        .agg(F.max("_gone").alias("_moved"))
    )
    typed = join_salted(
        changed.join(known_paths, [*keys, "path"], "left"),
        contents,
        [*keys, "blob_sha"],
        "left",
        rows_per_task,
    ).select(
        *tree,
        F.when(F.col("_known"), F.lit("M"))
        .when(F.col("_moved"), F.lit("R"))
        .when(F.col("_moved").isNotNull(), F.lit("C"))
        .otherwise(F.lit("A"))
        .alias("change_type"),
    )
    if with_deleted:
        typed = typed.unionByName(gone.withColumn("change_type", F.lit("D")))
    return typed


def file_versions_of(commits: DataFrame, trees: DataFrame, with_deleted: bool = False) -> DataFrame:
    """Changed files of every commit against its first parent.

    ``trees`` lists the whole tree of each commit (repo, commit_sha, path, blob_sha).  A
    commit without parents contributes all of its files.
    """
    first_parent = commits.select(
        "repo", "commit_sha", F.get("parents", F.lit(0)).alias("_parent")
    ).where(F.col("_parent").isNotNull())
    before = (
        first_parent.join(
            trees.withColumnRenamed("commit_sha", "_parent"), ["repo", "_parent"]
        ).drop("_parent")
    )
    return snapshot_diff(trees, before, ["repo", "commit_sha"], with_deleted)


# ---- trees that carry the hashes of their directories -------------------------------


def directory_of(path: Column) -> Column:
    """The directory a path lies in, '' for the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/", 1)).otherwise("")


def _above(path: Column) -> Column:
    """(dir, depth) of all directories above a path, the root first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth")),
    )


def directory_hashes(tree: DataFrame, keys: list[str] = ("repo",), sign: Column | None = None) -> DataFrame:
    """(keys, dir, parent, depth, n, h1, h2) of every directory of a tree (keys, path, blob_sha).

    h1 and h2 are the sums, over the files below, of 120 bits of a hash of path and content,
    so equal directories have equal sums, whatever the order of the files, and the hashes of
    a changed tree are those of the old one plus those of what came less those of what
    went (``changed_hashes``).  A directory with very many files is summed before the shuffle.
    """
    keys = list(keys)
    digest = F.sha2(F.concat_ws("\0", "blob_sha", "path"), 256)
    one = F.lit(1).cast("bigint") if sign is None else sign.cast("bigint")

    def bits(start: int) -> Column:
        return F.conv(F.substr(digest, F.lit(start), F.lit(15)), 16, 10).cast("decimal(20,0)") * one

    files = tree.select(*keys, F.explode(_above(F.col("path"))).alias("d"), one.alias("n"), bits(1).alias("h1"), bits(16).alias("h2"))
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("h1", "h2")]
    dirs = files.select(*keys, "d.dir", "d.depth", "n", "h1", "h2").groupBy(*keys, "dir", "depth")
    return dirs.agg(F.sum("n").alias("n"), *sums).select(
        *keys, "dir", F.when(F.col("depth") > 0, directory_of(F.col("dir"))).alias("parent"), "depth", "n", "h1", "h2"
    )


def changed_hashes(hashes: DataFrame, came: DataFrame, went: DataFrame, keys: list[str] = ("repo",)) -> DataFrame:
    """Hashes of a tree after files came and went, from those before."""
    keys = list(keys)
    more, less = directory_hashes(came, keys), directory_hashes(went, keys, F.lit(-1))
    sums = [F.sum(c).cast(kind).alias(c) for c, kind in (("n", "bigint"), ("h1", "decimal(38,0)"), ("h2", "decimal(38,0)"))]
    every = hashes.unionByName(more).unionByName(less).groupBy(*keys, "dir", "parent", "depth").agg(*sums)
    return every.where("n > 0")


def changed_directories(new: DataFrame, old: DataFrame, keys: list[str] = ("repo",)) -> DataFrame:
    """(keys, dir) of the directories that differ, from the hashes of two trees.

    From the root down: what lies below equal directories is not compared.  One round for
    each level; a round joins the directories of its level with the parents that differ.
    """
    keys, marks = list(keys), ["n", "h1", "h2"]
    found, level, frontier = None, 0, None
    deepest = max((r[0] for r in new.unionByName(old).agg(F.max("depth")).collect() if r[0] is not None), default=-1)
    while level <= deepest:
        sides = []
        for side, name in ((new, "_n"), (old, "_o")):
            rows = side.where(F.col("depth") == level)
            if frontier is not None:
                above = frontier.withColumnRenamed("dir", "parent")
                rows = rows.join(above, [*keys, "parent"], "left_semi")
            sides.append(rows.select(*keys, "dir", F.struct(*marks).alias(name)))
        both = sides[0].join(sides[1], [*keys, "dir"], "full")
        frontier = cut_lineage(both.where(~F.col("_n").eqNullSafe(F.col("_o"))).select(*keys, "dir"))
        if frontier.isEmpty():
            break
        found = frontier if found is None else found.unionByName(frontier)
        level += 1
    if found is None:
        return new.select(*keys, "dir").limit(0)
    return found


def files_in(tree: DataFrame, directories: DataFrame, keys: list[str] = ("repo",)) -> DataFrame:
    """The files that lie in one of the directories, not deeper."""
    keys = list(keys)
    inside = directories.withColumnRenamed("dir", "_dir")
    return tree.withColumn("_dir", directory_of(F.col("path"))).join(inside, [*keys, "_dir"], "left_semi").drop("_dir")


def snapshot_diff_by_hashes(
    new: DataFrame,
    old: DataFrame,
    new_hashes: DataFrame,
    old_hashes: DataFrame,
    keys: list[str] = ("repo",),
    with_deleted: bool = False,
) -> DataFrame:
    """``snapshot_diff`` of two trees whose directory hashes are known.

    Paths are compared in directories that differ only; the rest of the old tree is asked
    for nothing but the contents of files that seem to be new.
    """
    keys = list(keys)
    changed = cut_lineage(changed_directories(new_hashes, old_hashes, keys))
    before = cut_lineage(files_in(old, changed, keys))
    found = cut_lineage(snapshot_diff(files_in(new, changed, keys), before, keys, with_deleted))
    # a content that an unchanged directory still has was copied
    added = found.where("change_type = 'A'").select(*keys, "blob_sha").distinct()
    copied = old.select(*keys, "blob_sha").join(added, [*keys, "blob_sha"], "left_semi").distinct().withColumn("_copied", F.lit(True))
    kind = F.when((F.col("change_type") == "A") & F.col("_copied"), F.lit("C")).otherwise(F.col("change_type"))
    return found.join(copied, [*keys, "blob_sha"], "left").select(*keys, "path", "blob_sha", kind.alias("change_type"))
