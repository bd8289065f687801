"""Hits that are kept between scans.

What a content holds depends on the content and the rules only, so a table of hits keyed by
(blob_sha, digest of the rules) answers for contents that an earlier scan has read.  A scan
with such a table reads new contents only, and adds them.

Layout below the folder: ``hits/rules=<digest>/batch=<id>`` and then, as the commit of the
batch, ``seen/rules=<digest>/batch=<id>`` with the contents it has looked at.  Hits of a
batch whose second write is missing do not count, so a scan that breaks off changes
nothing; a content that two scans add at once counts from one of them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.operators.detect import detect
from credsieve.options import ScanOptions
from credsieve.rules import Rule
from credsieve.sources.files import readable_texts
from credsieve.storage import cut_lineage

# Options that change which hits a content has; all others are applied to hits later.
DETECTION = [
    "use_builtin_rules", "use_keywords", "use_entropy", "keywords", "keyword_case_sensitive", "min_value_length",
    "extra_stop_values", "base64_threshold", "hex_threshold", "ignore_markers", "max_file_size",
]


def rules_digest(options: ScanOptions, custom_rules: list[Rule] | DataFrame) -> str:
    """Equal for scans that find the same in a content."""
    known = asdict(options)
    settings = {name: known[name] for name in DETECTION}
    if isinstance(custom_rules, DataFrame):
        # the rows in any order, repeated ones counted
        columns = sorted(custom_rules.columns)
        of_row = F.sha2(F.to_json(F.struct(*columns)), 256)
        parts = [F.conv(F.substr(of_row, F.lit(1 + 15 * k), F.lit(15)), 16, 10).cast("decimal(20,0)") for k in range(4)]
        rules = [str(v) for v in custom_rules.agg(F.count("*"), *[F.sum(p) for p in parts]).head()] + columns
    else:
        rules = [[r.id, r.name, r.severity, r.pattern, sorted(r.literals), r.any_case] for r in custom_rules]
    return hashlib.sha256(json.dumps([settings, rules], sort_keys=True).encode()).hexdigest()


class HitStore:
    """A table of hits below ``path``, on storage that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _batches(self, kind: str, rules: str, schema: str) -> DataFrame:
        folder = f"{self.path}/{kind}/rules={rules}"
        schema += ", batch string"
        try:
            return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)
        except AnalysisException as exc:
            if not (exc.getCondition() or "").startswith("PATH_NOT_FOUND"):
                raise
            return self.spark.createDataFrame([], schema)

    def seen(self, rules: str) -> DataFrame:
        """(blob_sha, batch): contents that were looked at under these rules, each once."""
        rows = self._batches("seen", rules, "blob_sha string")
        return rows.groupBy("blob_sha").agg(F.min("batch").alias("batch"))

    def hits_of(
        self, blobs: DataFrame, options: ScanOptions | None = None, custom_rules: list[Rule] | DataFrame = ()
    ) -> DataFrame:
        """Hits of the contents, with their SEEN rows; only unknown contents are read."""
        options = options or ScanOptions()
        rules, batch = rules_digest(options, custom_rules), uuid.uuid4().hex
        # ids are compared first: contents move only if very many of them are new, else their
        # ids are few enough for a broadcast
        ids = blobs.select("blob_sha").distinct()
        unknown = cut_lineage(ids.join(self.seen(rules).select("blob_sha"), "blob_sha", "left_anti"))
        new = blobs.join(unknown, "blob_sha", "left_semi")
        found = detect(readable_texts(new, options), ["blob_sha"], "text", options, custom_rules, seen=True)
        found.write.parquet(f"{self.path}/hits/rules={rules}/batch={batch}")
        unknown.write.parquet(f"{self.path}/seen/rules={rules}/batch={batch}")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
        stored = self._batches("hits", rules, schema).join(self.seen(rules), ["blob_sha", "batch"], "left_semi")
        return stored.drop("batch").join(ids, "blob_sha", "left_semi")
