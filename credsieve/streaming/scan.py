"""Scanning file versions as they arrive.

The detectors are projections, so a stream runs the same plan as a table.  State is
kept for one thing only, the first sightings within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credsieve.operators.allowlist import drop_allowed
from credsieve.operators.detect import first_per_line, raw_hits
from credsieve.operators.paths import should_scan
from credsieve.operators.suppress import at_least, drop_known
from credsieve.options import ScanOptions
from credsieve.plans.reports import baseline_rows
from credsieve.plans.scan import described
from credsieve.rules import Rule
from credsieve.sources.files import is_text
from credsieve.storage import cut_lineage, delete


def stream_findings(
    texts: DataFrame,
    event_time: str = "committed_at",
    horizon: str = "1 day",
    options: ScanOptions | None = None,
    allowlist: DataFrame | None = None,
    baseline: DataFrame | None = None,
    custom_rules: list[Rule] | DataFrame = (),
    carry: list[str] = ("commit_seq",),
) -> DataFrame:
    """Findings of a stream of (repo, path, text, event time, carried columns).

    A secret seen again at the same place within the horizon is reported once.  Of the hits
    that arrive together the one the batch scan would keep is reported: the first by time
    and the carried columns, then by detector, rule and position.  Rows later than the watermark
    are dropped; the batch scan stays the authority on which commit came first.
    """
    options = options or ScanOptions()
    wanted = should_scan(F.col("path"), options) & is_text(F.col("text"), options)
    rows = texts.where(wanted).withColumnRenamed("path", "file_path")
    hits = raw_hits(rows, ["repo", "file_path", event_time, *carry], "text", options, custom_rules)
    hits = drop_allowed(hits, allowlist)
    first = first_sightings(hits, event_time, horizon, list(carry))
    return drop_known(described(at_least(first, options.min_severity)), baseline)


# Rows of a task that are settled together at least.
SETTLED = 50_000
SIGHTING = ["repo", "file_path", "line_number", "matched_text"]


def first_of_batch(
    hits: DataFrame, rank: list[str], place: list[str] = SIGHTING, partitions: int | None = None
) -> DataFrame:
    """Of the hits of a micro-batch at one place the first by ``rank``.

    The hits of a place come to one task; it keeps one row per place while its Arrow
    batches pass, and nothing from one micro-batch to the next.  ``rank`` decides all ties.
    """
    partitions = partitions or int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def first(tables: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(tables).sort_by([(c, "ascending") for c in rank])
        at = pa.array(range(rows.num_rows), pa.int64())
        places = rows.select(place).append_column("_at", at).group_by(place).aggregate([("_at", "min")])
        return rows.take(places.column("_at_min"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        waiting = 0
        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            waiting += batch.num_rows
            # as many new rows as there are places, so that each row is sorted a few times
            if waiting > max(SETTLED, kept[0].num_rows):
                kept, waiting = [first(kept)], 0
        if kept:
            yield from first(kept).combine_chunks().to_batches(max_chunksize=10_000)

    return hits.repartition(partitions, *place).mapInArrow(settle, hits.schema)


def first_sightings(hits: DataFrame, event_time: str, horizon: str, carry: list[str]) -> DataFrame:
    """One hit per (repo, file, line, text) within the horizon.

    What is kept between micro-batches is Spark's own: the places seen, until the
    watermark is a horizon past their first sighting.
    """
    first = first_of_batch(hits, [event_time, *carry, "det_rank", "rule_idx", "pos"])
    return first.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(SIGHTING)


def stream_history(
    versions: DataFrame,
    contents: DataFrame,
    version_time: str = "committed_at",
    content_time: str = "arrived_at",
    horizon: str = "1 day",
    options: ScanOptions | None = None,
    allowlist: DataFrame | None = None,
    baseline: DataFrame | None = None,
    custom_rules: list[Rule] | DataFrame = (),
    carry: list[str] = ("commit_seq",),
    salts: int = 1,
) -> DataFrame:
    """Findings of file versions (repo, path, blob_sha, time, carried columns) and contents
    (blob_sha, text, time) that arrive as streams of their own, in any order.

    A content is searched when it arrives; what waits, at most a ``horizon`` on either side,
    is a version for its content and hits for their versions.  A content of very many
    versions is dealt over ``salts`` tasks.  A secret is reported once per place within the
    horizon, for the version that met its content first.
    """
    options = options or ScanOptions()
    wanted = versions.where(should_scan(F.col("path"), options)).select(
        "repo", F.col("path").alias("file_path"), "blob_sha", version_time, *carry
    )
    salt = F.pmod(F.xxhash64("repo", "file_path"), F.lit(salts)).cast("int")
    wanted = wanted.withColumn("_salt", salt).withWatermark(version_time, horizon)
    texts = contents.where(is_text(F.col("text"), options))
    found = raw_hits(texts, ["blob_sha", content_time], "text", options, custom_rules)
    found = first_of_batch(found, [content_time, "det_rank", "rule_idx", "pos"], ["blob_sha", "line_number", "matched_text"])
    every = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    found = found.withColumn("_salt", every).withWatermark(content_time, horizon)
    found = found.withColumnRenamed("blob_sha", "_sha").withColumnRenamed("_salt", "_part")
    wait = F.expr(f"INTERVAL {horizon}")
    near = (F.col(content_time) >= F.col(version_time) - wait) & (F.col(content_time) <= F.col(version_time) + wait)
    met = wanted.join(found, (F.col("blob_sha") == F.col("_sha")) & (F.col("_salt") == F.col("_part")) & near)
    met = drop_allowed(met.drop("_sha", "_salt", "_part", content_time), allowlist)
    first = met.dropDuplicatesWithinWatermark(SIGHTING)
    return drop_known(described(at_least(first, options.min_severity)), baseline)


BASELINE = "repo string, fingerprint string, part int"
PARTS = 64
# Batches whose rows of the baseline are merged into one generation.
GENERATION = 16
# With at most this many new fingerprints, they are looked for in the files themselves.
FEW = 1000


def _part(repo: Column) -> Column:
    """Part of the baseline that knows a repository."""
    return F.pmod(F.hash(repo), PARTS).cast("int")


class RollingBaseline:
    """Fingerprints that earlier batches have reported.

    ``batches/batch=<n>`` holds what batch n has added.  Every GENERATION batches all that
    is older becomes ``generations/generation=<n>``, one file per part, sorted and with Bloom
    filters of the fingerprints; writing ``current/generation=<n>`` makes it count, and only
    then are the older files deleted.  A generation holds batches that are committed, so a
    batch that runs again sees what it saw before.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _rows(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)
        except AnalysisException as exc:
            if not (exc.getCondition() or "").startswith("PATH_NOT_FOUND"):
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int | None:
        """The newest generation that counts."""
        rows = self._rows(f"{self.path}/current", "done boolean, generation bigint")
        return rows.agg(F.max("generation")).head()[0]

    def before(self, batch: int) -> DataFrame:
        """(repo, fingerprint, part) of the batches before ``batch``."""
        newest = self.generation()
        rows = self._rows(f"{self.path}/batches", f"{BASELINE}, batch bigint").where(F.col("batch") < batch)
        if newest is None:
            return rows.drop("batch")
        old = self._rows(f"{self.path}/generations/generation={newest}", BASELINE)
        return old.unionByName(rows.where(F.col("batch") >= newest).drop("batch"))

    def known_of(self, findings: DataFrame, batch: int) -> DataFrame:
        """Rows of the baseline that may know one of the findings.

        Only parts of their repositories are read, and of few findings only files whose
        Bloom filter has one of their fingerprints.
        """
        parts = [r[0] for r in findings.select(_part(F.col("repo"))).distinct().collect()]  # PARTS at most
        known = self.before(batch).where(F.col("part").isin(parts))
        few = findings.select("fingerprint").distinct().limit(FEW + 1).collect()
        if len(few) <= FEW:
            known = known.where(F.col("fingerprint").isin([r[0] for r in few]))
        return known.select("repo", "fingerprint")

    def add(self, findings: DataFrame, batch: int) -> None:
        rows = baseline_rows(findings.withColumn("commit_sha", F.lit("")))
        rows = rows.select("repo", "fingerprint", _part(F.col("repo")).alias("part"))
        # a file for each part that has new rows
        dealt = rows.repartition("part")
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/batches/batch={batch}")

    def compact(self, batch: int) -> None:
        """Merge what the batches before ``batch`` have added; they must be committed."""
        target, older = f"{self.path}/generations/generation={batch}", self.generation()
        if older == batch:
            return  # done by an earlier attempt
        rows = self.before(batch).repartition(PARTS, "part").sortWithinPartitions("part", "fingerprint")
        rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#fingerprint", "true").partitionBy("part").parquet(target)
        done = self.spark.range(1).select(F.lit(True).alias("done"))
        done.write.mode("overwrite").parquet(f"{self.path}/current/generation={batch}")
        # from here on it counts: what it replaces goes
        batches = self._rows(f"{self.path}/batches", f"{BASELINE}, batch bigint")
        for r in batches.where(F.col("batch") < batch).select("batch").distinct().collect():  # some GENERATION
            delete(self.spark, f"{self.path}/batches/batch={r.batch}")
        if older is not None:
            delete(self.spark, f"{self.path}/generations/generation={older}")
            delete(self.spark, f"{self.path}/current/generation={older}")


def run_incremental(
    texts: DataFrame,
    findings_path: str,
    baseline_path: str,
    checkpoint: str,
    event_time: str = "committed_at",
    options: ScanOptions | None = None,
    allowlist: DataFrame | None = None,
    custom_rules: list[Rule] | DataFrame = (),
    carry: list[str] = ("commit_seq",),
    on_batch: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append new findings and roll the baseline forward, batch by batch.

    Each batch is compared with the baseline rows of earlier batches and writes its own
    folder, so a batch that is run again after a failure replaces its output instead of
    doubling it.  The baseline is partitioned by a hash of the repository, stores only
    fingerprints that are new, so each is there once, and merges its files as it goes.
    ``trigger`` holds the arguments of ``DataStreamWriter.trigger``; all that is there is
    read, then the query ends, if none are given.
    """
    options = options or ScanOptions()
    baseline = RollingBaseline(texts.sparkSession, baseline_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % GENERATION == 0:
            baseline.compact(batch_id)
        rows = batch.where(should_scan(F.col("path"), options) & is_text(F.col("text"), options))
        rows = rows.withColumnRenamed("path", "file_path")
        hits = raw_hits(rows, ["repo", "file_path", event_time, *carry], "text", options, custom_rules)
        found = drop_allowed(first_per_line(hits, ["repo", "file_path"], [event_time, *carry]), allowlist)
        # the batch is searched once, then looked up
        found = cut_lineage(described(at_least(found, options.min_severity)))
        out = f"{findings_path}/batch={batch_id}"
        drop_known(found, baseline.known_of(found, batch_id)).write.mode("overwrite").parquet(out)
        stored = batch.sparkSession.read.schema(found.schema).parquet(out)
        baseline.add(stored, batch_id)
        if on_batch:
            on_batch(stored, batch_id)

    return (
        texts.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
