"""The registered queries as DuckDB SQL."""

from __future__ import annotations

from credsieve.functions.findings import GITLAB_SEVERITIES, SARIF_LEVELS
from credsieve.rules import BUILTIN_RULES
from workloads import planted
from workloads.oracle_parts import (
    FINGERPRINT,
    RANKS,
    entropy_hits_cte,
    first_hits_cte,
    hits_ctes,
    keyword_hits_cte,
    lines_cte,
    matches_globs,
    noise_line,
    quoted,
    redacted,
    rule_hits_cte,
    rules_cte,
    scannable,
    valid_value,
)
from workloads.queries import (
    ALLOW_ROWS,
    CUSTOM_KEYWORDS,
    CUSTOM_RULES,
    NOISE_STARTS,
    PATH_ENDINGS,
    PATH_HEADS,
)

DOCS = f"docs AS ({planted.documents_sql(True)})"
SHOWN = "repo, path AS file_path, line_number, rule_id, rule_name, severity, matched_text, detection_type, round(entropy, 6) AS entropy"


def names(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def array(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def doc_findings(where: str = "TRUE") -> str:
    """CTE ``findings`` of the planted documents that are scannable."""
    return f"""WITH {DOCS}, texts AS (SELECT * FROM docs WHERE {scannable("path")}),
      {hits_ctes("texts", "repo, path")}, {first_hits_cte("repo, path", name="every")},
      findings AS (SELECT *, {RANKS} AS sev_rank, {FINGERPRINT} AS fingerprint, {redacted("matched_text")} AS redacted_value
                   FROM every WHERE {where})"""


def assignments(**kw) -> str:
    return f"""WITH {DOCS}, {lines_cte("docs", "doc_id")}, {keyword_hits_cte("doc_id", **kw)},
      firsts AS (SELECT * FROM keyword_hits QUALIFY row_number() OVER (
        PARTITION BY doc_id, line_number, lower(keyword), value ORDER BY form, pos) = 1)"""


WORDS = f"""{DOCS}, words AS (
      SELECT DISTINCT unnest(string_split(regexp_replace(text, '[\\s"'']+', ' ', 'g'), ' ')) AS word FROM docs)"""

BITS = "round(coalesce(list_aggregate(string_split({0}, ''), 'entropy'), 0), 6)".format


def rule_scan(only: str) -> str:
    return f"""WITH {DOCS}, {lines_cte("docs", "doc_id")}, {rules_cte()},
      {rule_hits_cte("docs", "doc_id", only=only)}
      SELECT doc_id, line_number, line AS line_content, rule_id, rule_name, severity, match AS matched_text
      FROM rule_hits JOIN rules USING (rule_idx)
      WHERE NOT regexp_matches(line, '(?i)credsieve\\s*:\\s*ignore|pragma\\s*:\\s*allowlist\\s+secret')"""


def entropy_rows(source: str, base64s: float) -> str:
    return f"""WITH {DOCS}, {source}, {lines_cte("texts", "path")},
      {entropy_hits_cte("path", base64s=base64s)}
      SELECT path, line_number, 'entropy-' || kind AS rule_id, token AS matched_text, round(min(bits), 6) AS bits
      FROM entropy_hits
      WHERE NOT regexp_matches(line, '(?i)credsieve\\s*:\\s*ignore|pragma\\s*:\\s*allowlist\\s+secret')
      GROUP BY ALL"""


PATHS = f"""{DOCS}, paths AS (
      SELECT DISTINCT path FROM (
        SELECT {array(PATH_HEADS)}[page_id % {len(PATH_HEADS)} + 1]
               || regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1)
               || {array(PATH_ENDINGS)}[page_id % {len(PATH_ENDINGS)} + 1] AS path FROM pages
        UNION ALL SELECT path FROM docs))"""


def allowed(entries) -> str:
    tests = []
    for pattern, scope, is_regex in entries:
        if pattern in ("", "[broken"):
            continue
        test = (
            f"regexp_matches(matched_text, {quoted(pattern)})"
            if is_regex
            else f"contains(matched_text, {quoted(pattern)})"
        )
        tests.append(f"({matches_globs('path', [scope])} AND {test})" if scope else test)
    return "(" + " OR ".join(tests) + ")"


ENTRY_LINES = f"""entry_lines AS (
      SELECT trim(CASE n % 6 WHEN 0 THEN '  # note ' || h WHEN 1 THEN substr(h, 1, 12) || '  # known value'
                  WHEN 2 THEN 'scope:en/* regex:^AC' || substr(h, 1, 8)
                  WHEN 3 THEN 'regex: ' || substr(h, 1, 6) || '.*$ #r'
                  WHEN 4 THEN 'scope:' || substr(h, 1, 6)
                  ELSE 'scope:*.txt ' || substr(h, 1, 10) END) AS line
      FROM (SELECT doc_id AS n, sha256(cast(doc_id AS varchar)) AS h FROM documents)),
    entries AS (
      SELECT CASE WHEN starts_with(body, 'regex:') THEN trim(substr(body, 7)) ELSE body END AS pattern, reason, scope,
             starts_with(body, 'regex:') AS is_regex
      FROM (SELECT reason, CASE WHEN starts_with(entry, 'scope:') THEN regexp_extract(entry, '^scope:\\s*(\\S+)\\s', 1) END AS scope,
                   CASE WHEN starts_with(entry, 'scope:') THEN regexp_extract(entry, '^scope:\\s*\\S+\\s+(\\S.*)$', 1) ELSE entry END AS body
            FROM (SELECT trim(CASE WHEN contains(line, ' #') THEN regexp_extract(line, '^(.*?)\\s+#', 1) ELSE line END) AS entry,
                         CASE WHEN contains(line, ' #') THEN trim(regexp_extract(line, '^.*?\\s+#(.*)$', 1)) ELSE '' END AS reason
                  FROM entry_lines WHERE line <> '' AND NOT starts_with(line, '#')))
      WHERE body <> '')"""

GLOB = "'(?s)' || replace(replace(scope, '.', '[.]'), '*', '.*')"

COMMITS = f"commits AS ({planted.commits_sql(True)})"
FILES = f"file_versions AS ({planted.file_versions_sql("turns")})"
TURNS = f"turns AS {planted.turns_sql()}, blobs AS (SELECT DISTINCT blob_sha, text FROM turns)"


def ancestors(name: str, starts: str) -> str:
    return f"""{name}(repo, commit_sha) AS (
      {starts}
      UNION
      SELECT e.repo, e.parent FROM {name} a
      JOIN (SELECT repo, commit_sha, unnest(parents) AS parent FROM commits) e
        ON e.repo = a.repo AND e.commit_sha = a.commit_sha)"""


HEADS = "SELECT repo, arg_max(commit_sha, commit_seq) AS commit_sha FROM commits GROUP BY repo"


def commits_after(seq: int) -> str:
    return f"""{COMMITS}, {ancestors("below_head", HEADS)},
      {ancestors("below_base", f"SELECT repo, commit_sha FROM commits WHERE commit_seq = {seq}")},
      selected AS (SELECT c.* FROM commits c JOIN below_head USING (repo, commit_sha)
                   ANTI JOIN below_base USING (repo, commit_sha))"""


def history(selected: str = "commits", ctes: str = COMMITS, scan: str | None = None, keep: str = "TRUE") -> str:
    """CTE ``findings``: every sighting of every hit of every file, the earliest kept."""
    scan = scan or scannable("path", ["vendor/*"])
    return f"""WITH RECURSIVE {ctes}, {TURNS}, {FILES}, {hits_ctes("blobs", "blob_sha")},
      files AS (SELECT f.repo, f.path, f.blob_sha, min(c.commit_seq) AS commit_seq
                FROM file_versions f JOIN {selected} c USING (repo, commit_sha) WHERE {scan} GROUP BY ALL),
      sightings AS (SELECT * FROM files JOIN hits USING (blob_sha) WHERE {keep}),
      {first_hits_cte("repo, path", "commit_seq,", "sightings", "firsts")},
      findings AS (SELECT f.*, c.commit_sha, c.author AS commit_author,
                          strftime(c.committed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS commit_date,
                          {FINGERPRINT} AS fingerprint, {redacted("matched_text")} AS redacted_value
                   FROM firsts f JOIN commits c USING (repo, commit_seq))"""


SUMMARY = f"""{history()},
      dirty AS (SELECT DISTINCT blob_sha FROM hits),
      n_files AS (SELECT repo, count(DISTINCT CASE WHEN blob_sha NOT IN (FROM dirty) THEN blob_sha END)
                              + count(CASE WHEN blob_sha IN (FROM dirty) THEN 1 END) AS total_files FROM files GROUP BY repo),
      n_commits AS (SELECT repo, count(*) AS total_commits FROM commits GROUP BY repo),
      n_findings AS (SELECT repo, count(*) AS total_findings,
                            {", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))}
                     FROM findings GROUP BY repo),
      summaries AS (SELECT repo, coalesce(total_files, 0) AS total_files, coalesce(total_findings, 0) AS total_findings,
                           coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high,
                           coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low,
                           coalesce(total_commits, 0) AS total_commits, cast(0 AS bigint) AS suppressed
                    FROM n_commits FULL JOIN n_files USING (repo) FULL JOIN n_findings USING (repo))"""

# order of a report; texts have neither commits nor more than one line of a kind per place
REPORT_ORDER = "sev_rank DESC, path, det_rank, rule_idx, line_number, pos, matched_text"
CELL = "CASE WHEN regexp_matches({0}, '^[=+\\-@\\t\\r]') THEN chr(39) || {0} ELSE {0} END".format
ODD = "CASE WHEN line_number % 3 = 0 THEN '=' || matched_text ELSE matched_text END"

ORACLES: dict[str, str] = {
    "keyword_scan": f"""{assignments()}
      SELECT doc_id, line_number, line AS line_content, keyword, value, form FROM firsts""",
    "keyword_options": f"""{assignments(
        words=CUSTOM_KEYWORDS.keywords, case=True, least=CUSTOM_KEYWORDS.min_value_length,
        extra=CUSTOM_KEYWORDS.extra_stop_values)}
      SELECT doc_id, line_number, keyword, value, form FROM firsts""",
    "value_filter": f"""WITH {WORDS}, pieces AS (
        SELECT unnest(string_split_regex(line, '[=,:] *')) AS value
        FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM docs)),
      vals AS (SELECT value FROM pieces UNION SELECT word FROM words)
      SELECT value, {valid_value("value")} AS valid FROM vals""",
    "noise_lines": f"""WITH {DOCS}, l AS (
        SELECT {array(NOISE_STARTS)}[doc_id % {len(NOISE_STARTS)} + 1] AS p, unnest(string_split(text, chr(10))) AS line FROM docs),
      every AS (SELECT line FROM l UNION SELECT p || line FROM l)
      SELECT line, {noise_line("line")} AS noise FROM every""",
    "shannon": f"WITH {WORDS} SELECT word, {BITS('word')} AS bits FROM words",
    "class_entropy": f"""WITH {WORDS}
      SELECT word, {BITS("regexp_replace(word, '[^0-9a-fA-F]+', '', 'g')")} AS hex_bits,
             {BITS("regexp_replace(word, '[^A-Za-z0-9+/=_-]+', '', 'g')")} AS base64_bits,
             CASE WHEN regexp_full_match(word, '[0-9a-fA-F]*') THEN 'hex'
                  WHEN regexp_full_match(word, '[A-Za-z0-9+/=_-]*') THEN 'base64' ELSE 'unknown' END AS encoding
      FROM words""",
    "entropy_scan": entropy_rows(
        "texts AS (SELECT path, text FROM docs UNION ALL SELECT 'page/' || page_id, html FROM pages)", 4.5
    ),
    "entropy_overlap_low_threshold": entropy_rows("texts AS (SELECT path, text FROM docs)", 3.8),
    "pattern_scan_line": rule_scan("line"),
    "pattern_scan_multiline": rule_scan("multi"),
    "line_matches": f"""WITH {DOCS}, {lines_cte("docs", "path", "numbered")},
      given AS (SELECT path, (line_number - 1) * 10 + 7 AS n, line AS text FROM numbered),
      {lines_cte("given", "path, n")}, {rules_cte()}, {rule_hits_cte("given", "path, n")}
      SELECT path, n AS line_number, rule_id, severity, line AS line_content, match AS matched_text,
             instr(line, match) - 1 AS start, instr(line, match) - 1 + length(match) AS "end"
      FROM rule_hits JOIN rules USING (rule_idx)""",
    "custom_rules": f"""WITH {DOCS}, {lines_cte("docs", "doc_id")}, {rules_cte([*BUILTIN_RULES, *CUSTOM_RULES])},
      {rule_hits_cte("docs", "doc_id", list(enumerate([*BUILTIN_RULES, *CUSTOM_RULES])))}
      SELECT doc_id, line_number, line AS line_content, rule_id, rule_name, severity, match AS matched_text
      FROM rule_hits JOIN rules USING (rule_idx)
      WHERE NOT regexp_matches(line, '(?i)credsieve\\s*:\\s*ignore|pragma\\s*:\\s*allowlist\\s+secret')
      QUALIFY row_number() OVER (PARTITION BY doc_id, line_number, match ORDER BY rule_idx) = 1""",
    "python_rules": f"""WITH {DOCS}, {lines_cte("docs", "doc_id")}
      SELECT DISTINCT doc_id, line_number, line AS line_content, 'conditional' AS rule_id, 'Conditional' AS rule_name,
             'LOW' AS severity, match AS matched_text
      FROM (SELECT *, unnest(regexp_extract_all(line, 'token = "| note')) AS match FROM lines)
      WHERE NOT regexp_matches(line, '(?i)credsieve\\s*:\\s*ignore|pragma\\s*:\\s*allowlist\\s+secret')""",
    "rule_rows": f"""WITH {DOCS}, {lines_cte("docs", "path")},
      rules AS (SELECT doc_id AS rule_idx, doc_id % 8 AS kind, sha256(cast(doc_id AS varchar)) AS h FROM documents),
      found AS (
        SELECT path, line_number, line, 0 AS kind, unnest(regexp_extract_all(line, 'prod_[0-9a-f]{{7,}}')) AS match FROM lines
        UNION ALL SELECT path, line_number, line, 1, unnest(regexp_extract_all(line, '(?i)sum [0-9a-f]{{12}}')) FROM lines
        UNION ALL SELECT path, line_number, line, 3, unnest(regexp_extract_all(line, 'ghp_[0-9a-f]{{6}}')) FROM lines
        UNION ALL SELECT path, line_number, line, 7, unnest(regexp_extract_all(line, 'db_password = "[0-9a-f]{{2}}')) FROM lines),
      matches AS (
        SELECT path, line_number, line, match, rule_idx, kind FROM found JOIN rules USING (kind)
        WHERE CASE kind WHEN 0 THEN substr(match, 6, 6) = substr(h, 1, 6) WHEN 1 THEN lower(substr(match, 5, 8)) = substr(h, 1, 8)
                        WHEN 3 THEN substr(match, 5, 6) = substr(h, 1, 6) ELSE substr(match, 16, 2) = substr(h, 1, 2) END
        UNION ALL SELECT path, line_number, line, unnest(regexp_extract_all(line, '[a-f0-9]{{64}}')), 4, 4 FROM lines)
      SELECT path, line_number, 'rule-' || rule_idx AS rule_id, 'rule-' || rule_idx AS rule_name,
             CASE kind WHEN 1 THEN 'LOW' ELSE 'HIGH' END AS severity, match AS matched_text
      FROM matches
      WHERE NOT regexp_matches(line, '(?i)credsieve\\s*:\\s*ignore|pragma\\s*:\\s*allowlist\\s+secret')
      QUALIFY row_number() OVER (PARTITION BY path, line_number, match ORDER BY rule_idx) = 1""",
    "rule_validation": """
      SELECT 'rule-' || doc_id AS id, CASE WHEN doc_id % 7 <> 4 THEN 'Rule ' || doc_id ELSE 'rule-' || doc_id END AS name,
             CASE WHEN doc_id % 7 = 1 THEN '[unclosed' ELSE 'x{2}' || doc_id END AS pattern,
             CASE doc_id % 7 WHEN 2 THEN 'ODD' WHEN 6 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
             doc_id % 7 NOT IN (1, 2) AS valid,
             CASE doc_id % 7 WHEN 1 THEN 'invalid regex:' WHEN 2 THEN 'invalid severity' END AS reason
      FROM documents WHERE doc_id % 7 NOT IN (3, 5)""",
    "detect_all": f"{doc_findings()} SELECT {SHOWN} FROM findings",
    "injected_engine": f"""WITH {DOCS}, texts AS (SELECT * FROM docs WHERE starts_with(path, 'en/')),
      {hits_ctes("texts", "repo, path")}, {first_hits_cte("repo, path")}
      SELECT {SHOWN} FROM findings WHERE length(matched_text) % 2 = 0""",
    "inline_ignore": f"""WITH {DOCS}, {hits_ctes("docs", "path", ignore=False)}, {first_hits_cte("path")}
      SELECT path, line_number, rule_id, matched_text FROM findings
      WHERE regexp_matches(line, '(?i)credsieve\\s*:\\s*ignore|pragma\\s*:\\s*allowlist\\s+secret')""",
    "path_filter": f"""WITH {PATHS}
      SELECT path, string_split(replace(path, chr(92), '/'), '/')[-1] AS name, {scannable("path")} AS scanned FROM paths""",
    "path_filter_custom": f"""WITH {PATHS}
      SELECT path, {scannable("path", ["*.txt", "src/*", "*.lock"], ["poetry.lock", "en/1*"])} AS scanned FROM paths""",
    "readable_files": """
      SELECT cast(page_id AS varchar) AS page, length(text) AS n_chars, sha256(text) AS digest
      FROM (SELECT page_id, CASE page_id % 5 WHEN 3 THEN html || ' bad ' || chr(65533) || chr(65533) || ' end'
                                 WHEN 1 THEN html || chr(0) ELSE html END AS text,
                   strlen(html) + CASE page_id % 5 WHEN 1 THEN 1 WHEN 3 THEN 11 ELSE 0 END AS bytes, strlen(html) AS plain
            FROM pages)
      WHERE page_id % 5 <> 2 AND bytes <= 9000 AND NOT (page_id % 5 = 1 AND plain < 8192)""",
    "allowlist_parse": f"WITH {ENTRY_LINES} SELECT pattern, reason, scope, is_regex FROM entries",
    "allowlist": f"{doc_findings()} SELECT {SHOWN} FROM findings WHERE NOT {allowed(ALLOW_ROWS)}",
    "allowlist_long": f"""{doc_findings()}, {ENTRY_LINES}
      SELECT {SHOWN} FROM findings f WHERE NOT EXISTS (
        SELECT 1 FROM entries e
        WHERE (scope IS NULL OR regexp_full_match(path, {GLOB}) OR regexp_full_match(string_split(path, '/')[-1], {GLOB}))
          AND CASE WHEN is_regex THEN regexp_matches(matched_text, pattern) ELSE contains(matched_text, pattern) END)
        AND NOT (starts_with(path, 'fr/') AND (contains(matched_text, 'ab') OR contains(matched_text, 'zzzqqq')))""",
    "min_severity": f"{doc_findings('sev_rank >= 2')} SELECT {SHOWN} FROM findings",
    "gates": f"""{doc_findings()}
      SELECT gate, n_failing, n_failing > 0 AS failed, cast(CASE WHEN n_failing > 0 THEN 1 ELSE 0 END AS bigint) AS exit_code
      FROM (SELECT 'any' AS gate, count(*) AS n_failing FROM findings
            UNION ALL SELECT 'critical', count(*) FROM findings WHERE sev_rank = 3
            UNION ALL SELECT 'none', 0)""",
    "baseline_filter": f"""{doc_findings()}
      SELECT CASE WHEN fingerprint < 'a' THEN 'suppressed' ELSE 'new' END AS state, repo, path AS file_path, line_number,
             fingerprint FROM findings""",
    "baseline_write": f"""{doc_findings("sev_rank >= 1")}
      SELECT repo, fingerprint, rule_id, rule_name, path AS file_path, severity, redacted_value, '' AS commit_sha
      FROM findings WHERE fingerprint >= 'a'
      QUALIFY row_number() OVER (PARTITION BY repo, fingerprint ORDER BY {REPORT_ORDER}) = 1""",
    "commit_ranges": f"WITH RECURSIVE {commits_after(1)} SELECT repo, commit_sha, commit_seq, author FROM selected WHERE repo IN (SELECT repo FROM commits WHERE commit_seq = 1)",
    "commit_numbers": f"""WITH {COMMITS}
      SELECT repo, commit_sha, row_number() OVER (PARTITION BY repo ORDER BY committed_at, commit_sha) AS commit_seq FROM commits""",
    "head_tree": f"""WITH {COMMITS}, {TURNS}, {FILES}
      SELECT repo, path, blob_sha FROM file_versions JOIN commits USING (repo, commit_sha)
      QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY commit_seq DESC) = 1""",
    "head_only": f"""WITH {COMMITS}
      SELECT repo, commit_sha, commit_seq FROM commits QUALIFY row_number() OVER (PARTITION BY repo ORDER BY commit_seq DESC) = 1""",
    "head_scan": f"""WITH {COMMITS}, {TURNS}, {FILES}, {hits_ctes("blobs", "blob_sha")},
      tree AS (SELECT repo, path, blob_sha FROM file_versions JOIN commits USING (repo, commit_sha)
               QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY commit_seq DESC) = 1),
      sightings AS (SELECT * FROM tree JOIN hits USING (blob_sha) WHERE {scannable("path")}),
      {first_hits_cte("repo, path", source="sightings")}
      SELECT repo, path AS file_path, line_number, rule_id, severity, matched_text, commit_sha
      FROM findings JOIN ({HEADS}) USING (repo)""",
    "snapshot_changes": f"""WITH {TURNS}, new AS ({planted.tree_sql("turns", 0)}), old AS ({planted.tree_sql("turns", 2)}),
      gone AS (SELECT * FROM old ANTI JOIN new USING (repo, path))
      SELECT repo, path, blob_sha,
             CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.repo = n.repo AND o.path = n.path) THEN 'M'
                  WHEN EXISTS (SELECT 1 FROM gone o WHERE o.repo = n.repo AND o.blob_sha = n.blob_sha) THEN 'R'
                  WHEN EXISTS (SELECT 1 FROM old o WHERE o.repo = n.repo AND o.blob_sha = n.blob_sha) THEN 'C'
                  ELSE 'A' END AS change_type
      FROM (SELECT * FROM new ANTI JOIN old USING (repo, path, blob_sha)) n
      UNION ALL SELECT repo, path, blob_sha, 'D' FROM gone""",
    "tree_changes": f"""WITH {TURNS}, after AS ({planted.tree_sql("turns", 0)}), before AS ({planted.tree_sql("turns", 2)}),
      new AS (SELECT 'all' AS repo, repo || '/' || path AS path, blob_sha FROM (
        SELECT * FROM after WHERE cast(substr(repo, 5) AS bigint) % 2 = 0
        UNION ALL SELECT * FROM before WHERE cast(substr(repo, 5) AS bigint) % 2 = 1)),
      old AS (SELECT 'all' AS repo, repo || '/' || path AS path, blob_sha FROM before),
      gone AS (SELECT * FROM old ANTI JOIN new USING (repo, path))
      SELECT repo, path, blob_sha,
             CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.repo = n.repo AND o.path = n.path) THEN 'M'
                  WHEN EXISTS (SELECT 1 FROM gone o WHERE o.repo = n.repo AND o.blob_sha = n.blob_sha) THEN 'R'
                  WHEN EXISTS (SELECT 1 FROM old o WHERE o.repo = n.repo AND o.blob_sha = n.blob_sha) THEN 'C'
                  ELSE 'A' END AS change_type
      FROM (SELECT * FROM new ANTI JOIN old USING (repo, path, blob_sha)) n
      UNION ALL SELECT repo, path, blob_sha, 'D' FROM gone""",
    "pending": f"""WITH {TURNS}, new AS ({planted.tree_sql("turns", 0)}), old AS ({planted.tree_sql("turns", 2)}),
      {hits_ctes("blobs", "blob_sha")},
      sightings AS (SELECT * FROM (SELECT * FROM new ANTI JOIN old USING (repo, path, blob_sha)) JOIN hits USING (blob_sha)
                    WHERE {scannable("path")}),
      {first_hits_cte("repo, path", source="sightings")}
      SELECT repo, path AS file_path, line_number, rule_id, matched_text, 'Current User (Staged)' AS commit_author,
             'Working Tree' AS commit_date FROM findings""",
    "history_scan": f"""{history()}
      SELECT repo, path AS file_path, line_number, rule_id, severity, matched_text, commit_sha, commit_author, commit_date,
             redacted_value, fingerprint FROM findings""",
    "history_lines": f"""{history(scan=f"({scannable('path', ['vendor/*'])}) AND starts_with(path, 'docs/')")}
      SELECT repo, '[' || severity || '] ' || rule_name || ' in ' || path || ':' || line_number || ' (' || redacted_value || ') @ '
             || substr(commit_sha, 1, 8) AS summary, fingerprint FROM findings""",
    "baseline_documents": f"""{doc_findings()}
      SELECT repo, path AS file_path, line_number, fingerprint FROM findings WHERE fingerprint >= '8'""",
    "blob_reuse": f"""{history(keep="NOT (starts_with(path, 'turn') AND (contains(matched_text, '-') OR contains(matched_text, 'a')))")}
      SELECT repo, path AS file_path, line_number, rule_id, matched_text, commit_sha FROM findings""",
    "range_scan": f"""{history("selected", commits_after(0), scannable("path"))}
      SELECT repo, path AS file_path, line_number, rule_id, matched_text, commit_sha FROM findings""",
    "scan_summary": f"{SUMMARY} SELECT * FROM summaries",
    "suppressed_summary": f"""{history()}
      SELECT repo, count(fingerprint) FILTER (fingerprint >= '4') AS total_findings, count(fingerprint) FILTER (fingerprint < '4') AS suppressed
      FROM (SELECT DISTINCT repo FROM commits) LEFT JOIN findings USING (repo) GROUP BY repo""",
    "scan_totals": f"""{SUMMARY} SELECT {", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in (
        "total_files", "total_findings", "n_critical", "n_high", "n_medium", "n_low", "total_commits", "suppressed"))}
      FROM summaries""",
    "severities": f"""{doc_findings()}
      SELECT s AS severity, cast(r AS bigint) AS sev_rank, (SELECT count(*) FROM findings f WHERE f.severity = s) AS n_findings
      FROM (VALUES ('LOW', 0), ('MEDIUM', 1), ('HIGH', 2), ('CRITICAL', 3)) v(s, r)""",
    "findings_report": f"""{doc_findings()}
      SELECT row_number() OVER (ORDER BY {REPORT_ORDER}) AS position, repo, path AS file_path, line_number, line AS line_content, cast(sev_rank AS bigint) AS sev_rank, redacted_value, fingerprint,
             '[' || severity || '] ' || rule_name || ' in ' || path || ':' || line_number || ' (' || redacted_value || ') @ N/A' AS summary
      FROM findings""",
    "findings_table": f"{doc_findings()} SELECT {SHOWN} FROM findings",
    "json_documents": f"""{SUMMARY}
      SELECT repo, rule_id, path AS file_path, redacted_value AS matched_text, commit_sha, cast(line_number AS varchar) AS line_number,
             fingerprint, total_commits, total_files, total_findings, n_critical
      FROM findings JOIN summaries USING (repo)""",
    "sarif_documents": f"""{doc_findings()}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {REPORT_ORDER}) AS place FROM findings)
      SELECT repo, '2.1.0' AS version, row_number() OVER (PARTITION BY repo ORDER BY min(place)) - 1 AS rule_index,
             rule_id AS head_rule, arg_min(rule_name, place) AS rule_name, rule_id, count(*) AS n_results
      FROM ranked GROUP BY repo, rule_id""",
    "baseline_written": f"""{doc_findings()}, entries AS (
        SELECT *, count(*) OVER (PARTITION BY repo) AS total_findings FROM (
          SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY repo, fingerprint ORDER BY {REPORT_ORDER}) = 1))
      SELECT repo, fingerprint, rule_id, path AS file_path, severity, redacted_value, 'credsieve' AS generator,
             '2024-05-06T07:08:09+00:00' AS generated_at, total_findings FROM entries""",
    "csv_report": f"""{doc_findings()}
      SELECT {CELL("rule_id")} AS rule_id, {CELL("rule_name")} AS rule_name, severity, {CELL("path")} AS file_path, line_number,
             {CELL(f"({ODD})")} AS matched_text, '' AS commit_sha, '' AS commit_author, '' AS commit_date, detection_type
      FROM findings""",
    "redacted_json": f"""{doc_findings()}
      SELECT repo, rule_id, path AS file_path, line AS line_content, redacted_value AS matched_text, redacted_value,
             fingerprint, cast(line_number AS varchar) AS line_number FROM findings""",
    "sarif_report": f"""{doc_findings()}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {REPORT_ORDER}) AS place FROM findings),
      indexes AS (SELECT repo, rule_id, row_number() OVER (PARTITION BY repo ORDER BY min(place)) - 1 AS i
                  FROM ranked GROUP BY repo, rule_id)
      SELECT repo, rule_id, cast(i AS varchar) AS rule_index, {names("severity", SARIF_LEVELS)} AS level,
             'Potential secret detected: ' || rule_name || ' (' || redacted_value || ')' AS message,
             path AS uri, cast(line_number AS varchar) AS start_line, detection_type
      FROM findings JOIN indexes USING (repo, rule_id)""",
    "gitlab_report": f"""{doc_findings()}
      SELECT repo, rule_id AS check_name, 'Secret detected: ' || rule_name || ' (' || redacted_value || ')' AS description,
             {names("severity", GITLAB_SEVERITIES)} AS severity, fingerprint, 'Security' AS category, path,
             cast(line_number AS varchar) AS begin FROM findings""",
    "report_document_sizes": f"""{doc_findings()}
      SELECT repo, count(*) + 2 AS n_lines, count(*) - 1 AS n_commas, cast(2 AS bigint) AS n_ends FROM findings GROUP BY repo""",
    "stream_incremental": f"""WITH {TURNS}, texts AS (
        SELECT DISTINCT repo, turn, 'turn' || (turn % 3) || '.txt' AS path, text FROM turns),
      {hits_ctes("texts", "repo, turn, path")}, {first_hits_cte("repo, path", "turn,")}
      SELECT repo, path AS file_path, line_number, rule_id, severity, matched_text, turn AS commit_seq FROM findings""",
    "stream_scan": f"""WITH {TURNS}, texts AS (
        SELECT DISTINCT repo, turn, 'turn' || (turn % 3) || '.txt' AS path, text FROM turns),
      {hits_ctes("texts", "repo, turn, path")}, {first_hits_cte("repo, path", "turn,")}
      SELECT repo, path AS file_path, line_number, rule_id, severity, matched_text FROM findings""",
    "stream_late_contents": f"""WITH {TURNS}, texts AS (
        SELECT DISTINCT repo, turn, 'turn' || (turn % 3) || '.txt' AS path, text FROM turns),
      {hits_ctes("texts", "repo, turn, path")}
      SELECT DISTINCT repo, path AS file_path, line_number, matched_text FROM hits""",
    "commit_index": f"""WITH RECURSIVE {COMMITS},
      reach(repo, start, commit_sha) AS (
        SELECT repo, commit_sha, commit_sha FROM commits
        UNION SELECT r.repo, r.start, unnest(c.parents) FROM reach r JOIN commits c USING (repo, commit_sha)),
      lasts AS (SELECT repo, max(commit_seq) AS last FROM commits GROUP BY repo),
      asked AS (SELECT repo, commit_seq AS top, commit_sha AS head, unnest([0, 2, 4]) AS back
                FROM commits JOIN lasts USING (repo) WHERE commit_seq % 3 = 2 OR commit_seq = last),
      based AS (SELECT a.*, b.commit_sha AS base FROM asked a
                LEFT JOIN commits b ON a.back > 0 AND b.repo = a.repo AND b.commit_seq = a.top - a.back)
      SELECT a.repo, a.back || '-' || a.top AS range_id, r.commit_sha
      FROM based a JOIN reach r ON r.repo = a.repo AND r.start = a.head
      WHERE NOT EXISTS (SELECT 1 FROM reach b WHERE b.repo = a.repo AND b.start = a.base AND b.commit_sha = r.commit_sha)""",
    "stream_severity": f"""WITH {TURNS}, texts AS (
        SELECT DISTINCT repo, turn, 'turn' || (turn % 3) || '.txt' AS path, text FROM turns),
      {hits_ctes("texts", "repo, turn, path")}, {first_hits_cte("repo, path", "turn,")}
      SELECT repo, path AS file_path, line_number, rule_id, severity, matched_text FROM findings WHERE severity <> 'LOW'""",
    "stream_baseline": f"""WITH {TURNS}, texts AS (
        SELECT DISTINCT repo, turn, 'turn' || (turn % 3) || '.txt' AS path, text FROM turns),
      {hits_ctes("texts", "repo, turn, path")}, {first_hits_cte("repo, path", "turn,")},
      marked AS (SELECT *, {FINGERPRINT} AS fingerprint FROM findings)
      SELECT repo, path AS file_path, line_number, rule_id, severity, matched_text FROM marked WHERE fingerprint >= '8'""",
    "rescan": f"""{history()}
      SELECT repo, path AS file_path, line_number, rule_id, matched_text, commit_sha, fingerprint FROM findings""",
}
