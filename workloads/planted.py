"""Test inputs derived from the given tables.

The tables hold few secrets, so lines are added to their texts.  The added lines are
written once, as SQL that Spark and DuckDB both understand; only the hash function has
two names.  Tokens are put together from prefix and body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

H = "substr(h, {}, {})".format
UUID = " || '-' || ".join(H(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
BREAK = "CASE WHEN n % 84 >= 42 THEN chr(10) ELSE '' END"

# token of rule number n % 42, in rule order; some are broken over two lines
TOKENS = [
    f"'AKIA' || upper({H(1, 16)})",
    f"'ASIA' || upper({H(1, 16)})",
    f"'amzn.mws.' || {UUID}",
    f"'sk-proj-' || {H(1, 24)}",
    f"'sk-ant-api03-' || h || {H(1, 20)}",
    f"'hf_' || {H(1, 34)}",
    f"'ghp_' || {H(1, 36)}",
    f"'github_pat_' || h || {H(1, 18)}",
    f"'gho_' || {H(1, 36)}",
    f"'ghs_' || {H(1, 36)}",
    f"'glpat-' || {H(1, 20)}",
    f"'GR1348941' || {H(1, 20)}",
    f"'xoxb-1234567890-1234567890-' || {H(1, 24)}",
    f"'xoxp-1234567890-1234567890-1234567890-' || {H(1, 32)}",
    f"'https://hooks.slack.com/services/T' || {H(1, 8)} || '/B' || {H(9, 8)} || '/' || {H(17, 24)}",
    f"'sk_live_' || {H(1, 24)}",
    f"'pk_live_' || {H(1, 24)}",
    f"'rk_live_' || {H(1, 24)}",
    f"'AIza' || {H(1, 35)}",
    f"'\"type\": ' || {BREAK} || '\"service_account\"'",
    f"'\"client_secret\": ' || {BREAK} || '\"' || {H(1, 24)} || '\"'",
    f"'azure_key = ' || {BREAK} || {H(1, 32)}",
    f"'DefaultEndpointsProtocol=https;AccountName=ac' || {BREAK} || 'ct;AccountKey=' || {H(1, 40)} || ';'",
    "'dop_v1_' || h",
    f"'hvs.' || {H(1, 24)}",
    f"'dapi' || {H(1, 32)}",
    f"'PMAK-' || {H(1, 24)} || '-' || {H(1, 34)}",
    f"'AC' || {H(1, 32)}",
    f"'SK' || {H(1, 32)}",
    f"'SG.' || {H(1, 22)} || '.' || {H(1, 43)}",
    f"'key-' || {H(1, 32)}",
    f"'npm_' || {H(1, 36)}",
    f"'pypi-' || h || {H(1, 40)}",
    f"'dckr_pat_' || {H(1, 20)}",
    "'-----BEGIN RSA ' || 'PRIVATE KEY-----'",
    f"'eyJ' || {H(1, 12)} || '.eyJ' || {H(13, 12)} || '.' || {H(25, 12)}",
    f"'heroku_api_key = ' || {BREAK} || {UUID}",
    f"'123456789:' || {H(1, 35)}",
    f"'M' || {H(1, 23)} || '.' || {H(24, 6)} || '.' || {H(30, 27)}",
    f"'shpat_' || {H(1, 32)}",
    f"'shpss_' || {H(1, 32)}",
    f"'sq0atp-' || {H(1, 22)}",
]
ASSIGNMENTS = [
    f"'db_password = \"' || {H(1, 24)} || '\"'",
    f"'\"api_key\": \"' || {H(1, 24)} || '\"'",
    f"'export TOKEN=' || {H(1, 24)}",
    f"chr(39) || 'secret' || chr(39) || ' => ' || chr(39) || {H(1, 24)} || chr(39)",
    "'password = \"changeme\"'",
    f"'# password = \"' || {H(1, 24)} || '\"'",
    "'api_key = os.getenv(' || chr(39) || 'K' || chr(39) || ')'",
    f"'my_token = prod_' || {H(1, 20)} || ' # note'",
    f"'database_url = \"postgres://admin:s3#' || {H(1, 8)} || '@db/prod\"'",
    "'public token = \"abc-xyz-123\"'",
    f"'PWD: ' || {H(1, 9)} || '// x, secret = ' || {H(1, 9)}",
]
BLOBS = [
    "'blob: ' || base64(unhex(h))",
    f"'see https://x.example/a?q=' || {H(1, 32)} || ' and ' || {H(33, 12)}",
    f"'sum ' || {H(1, 40)} || ' a-b-' || {H(1, 20)}",
    f"'mix ' || {H(1, 12)} || '_KLMNOPQRSTUVWXYZghijklmnop' || {H(13, 12)}",
    f"'far https://x.example/' || repeat('z.', 30) || {H(1, 24)}",
]


def _choice(n: str, options: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {option}" for i, option in enumerate(options))
    return f"CASE {n} % {len(options)} {whens} END"


MARKER = (
    "CASE WHEN n % 5 = 0 THEN ' # credsieve:ignore' "
    "WHEN n % 15 = 1 THEN ' // pragma: allowlist secret' ELSE '' END"
)
ADDED = (
    f"chr(10) || 'val=\"' || ({_choice('n', TOKENS)}) || '\" end' || {MARKER}"
    f" || chr(10) || ({_choice('n', ASSIGNMENTS)}) || chr(10) || ({_choice('n', BLOBS)})"
)


def _hash(text: str, duck: bool) -> str:
    return f"sha256({text})" if duck else f"sha2({text}, 256)"


def documents_sql(duck: bool) -> str:
    """(doc_id, repo, path, text) of documents with added lines."""
    return f"""
      SELECT doc_id, source AS repo, lang || '/' || cast(doc_id AS varchar(20)) || '.txt' AS path,
             text || {ADDED} AS text
      FROM (SELECT *, doc_id AS n, {_hash("cast(doc_id AS varchar(20))", duck)} AS h FROM documents) d
    """


def turn_texts_sql(duck: bool) -> str:
    """(repo, turn, role, text) of conversations with added lines."""
    pair = "cast(floor(turn / 2.0) AS bigint)"  # two turns share their added lines
    name = f"cast(conv_id AS varchar(20)) || ':' || cast({pair} AS varchar(20))"
    return f"""
      SELECT 'conv' || cast(conv_id AS varchar(20)) AS repo, turn, role, text || {ADDED} AS text
      FROM (SELECT *, conv_id + {pair} AS n, {_hash(name, duck)} AS h FROM conversations) c
    """


def turns_sql() -> str:
    """For DuckDB: the same with the hash of the text as blob_sha."""
    return f"(SELECT *, sha256(text) AS blob_sha FROM ({turn_texts_sql(True)}) t)"


def commits_sql(duck: bool) -> str:
    """Commits: one per turn, after the turn before; every third one also merges the turn
    two before."""
    one, two = "repo || '-' || cast(turn - 1 AS varchar(20))", "repo || '-' || cast(turn - 2 AS varchar(20))"
    array = "[{}]".format if duck else "array({})".format
    none = "cast([] AS varchar[])" if duck else "cast(array() AS array<string>)"
    at = (
        "timestamp '1970-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn)"
        if duck
        else "timestamp_seconds(conv_id * 3600 + turn * 60)"
    )
    return f"""
      SELECT repo, repo || '-' || cast(turn AS varchar(20)) AS commit_sha,
             CASE WHEN turn = 0 THEN {none}
                  WHEN turn % 3 = 2 THEN {array(one + ', ' + two)}
                  ELSE {array(one)} END AS parents,
             turn AS commit_seq, role AS author, {at} AS committed_at, 'turn' AS message
      FROM (SELECT *, 'conv' || cast(conv_id AS varchar(20)) AS repo FROM conversations) c
    """


def file_versions_sql(turns: str) -> str:
    """Every turn changes one of three files; every second one also copies it into docs/
    or vendor/."""
    sha = "repo || '-' || cast(turn AS varchar(20))"
    return f"""
      SELECT repo, {sha} AS commit_sha, 'turn' || cast(turn % 3 AS varchar(20)) || '.txt' AS path,
             blob_sha, CASE WHEN turn < 3 THEN 'A' ELSE 'M' END AS change_type
      FROM {turns} a
      UNION ALL
      SELECT repo, {sha} AS commit_sha,
             CASE WHEN turn % 4 = 1 THEN 'docs/' ELSE 'vendor/' END || 'copy' || cast(turn % 3 AS varchar(20)) || '.txt' AS path,
             blob_sha, 'A' AS change_type
      FROM {turns} b WHERE turn % 2 = 1
    """


def tree_sql(turns: str, back: int) -> str:
    """(repo, path, blob_sha): files of a conversation ``back`` turns before its last one; the
    turns up to there stand in files turn % 3, so later ones replace earlier ones; turn 2
    lies elsewhere in older trees."""
    return f"""
      SELECT repo, path, blob_sha FROM (
        SELECT repo, CASE WHEN turn = 2 AND {back} > 0 THEN 'old/turn2.txt'
                          ELSE 'turn' || cast(turn % 3 AS varchar(20)) || '.txt' END AS path, blob_sha,
               row_number() OVER (PARTITION BY repo, turn % 3 ORDER BY turn DESC) AS r
        FROM (SELECT *, max(turn) OVER (PARTITION BY repo) AS last FROM {turns}) x
        WHERE turn <= last - {back}) y
      WHERE r = 1
    """


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _spread(df: DataFrame) -> DataFrame:
    """The given tables are single small files; a real table has partitions enough."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _once(df: DataFrame, column: str) -> DataFrame:
    """Compute a long expression once, not in every place that uses it."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.array(column)).alias(column))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).createOrReplaceTempView("documents")
    return _once(spark.sql(documents_sql(False)), "text")


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents; their texts are neither read nor shuffled."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    _spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")).createOrReplaceTempView("conversations")
    return with_blob(spark)


def with_blob(spark: SparkSession) -> DataFrame:
    """Turns of the view ``conversations`` with the hash of their text."""
    texts = _once(spark.sql(turn_texts_sql(False)), "text")
    return texts.withColumn("blob_sha", F.sha2("text", 256))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "conversations")
    return spark.sql(commits_sql(False))


def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns(spark, sf_dir).createOrReplaceTempView("turns")
    return spark.sql(file_versions_sql("turns"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("blob_sha", "text").dropDuplicates(["blob_sha"])


def tree(spark: SparkSession, sf_dir: str, back: int) -> DataFrame:
    turns(spark, sf_dir).createOrReplaceTempView("turns")
    return spark.sql(tree_sql("turns", back))
