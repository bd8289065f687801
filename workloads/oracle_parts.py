"""The detectors in plain SQL, step by step as their definition reads: occurrences with
their positions first, filters on them next, overlaps and repeats last."""

from __future__ import annotations

import re

from credsieve.functions import values as V
from credsieve.operators.keywords import FORMS
from credsieve.options import EXCLUDED_PATHS, KEYWORDS
from credsieve.rules import BUILTIN_RULES, Rule

MULTILINE = {
    "gcp-service-account", "google-oauth-client-secret", "azure-subscription-key",
    "azure-connection-string", "heroku-api-key",
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def one_of(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def bounded(pattern: str) -> str:
    """Look-arounds one character wide as consumed characters; group 1 is the match."""
    left, body, right = re.fullmatch(
        r"(?:\(\?<!\[([^\]]*)\]\))?(.*?)(?:\(\?!\[([^\]]*)\]\))?", pattern
    ).groups()
    return (
        (f"(?:^|[^{left}])" if left else "") + f"({body})" + (f"(?:$|[^{right}])" if right else "")
    )


def lines_cte(source: str, keys: str, name: str = "lines") -> str:
    return f"""{name} AS (
      SELECT {keys}, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_number
      FROM (SELECT {keys}, string_split(text, chr(10)) AS ls FROM {source}))"""


def rule_hits_cte(
    source: str, keys: str, rules: list[tuple[int, Rule]] | None = None, name: str = "rule_hits",
    multiline: set[str] = MULTILINE, only: str = "both",
) -> str:
    """(keys, rule_idx, line_number, line, match)."""
    rules = list(enumerate(BUILTIN_RULES)) if rules is None else rules
    parts = []
    for i, rule in rules:
        if rule.id in multiline and only != "line":
            rx = quoted(rule.pattern)
            parts.append(f"""
              SELECT {keys}, {i} AS rule_idx, 1 + before AS line_number,
                     string_split(text, chr(10))[1 + before] AS line, match
              FROM (SELECT {keys}, text, match,
                      cast(sum(length(gap) - length(replace(gap, chr(10), ''))) OVER w
                      + coalesce(sum(length(match) - length(replace(match, chr(10), ''))) OVER (
                          PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS before
                    FROM (SELECT {keys}, text, unnest(ms) AS match, unnest(gaps[1:len(ms)]) AS gap,
                                 generate_subscripts(ms, 1) AS k
                          FROM (SELECT {keys}, text, regexp_extract_all(text, {rx}) AS ms,
                                       regexp_split_to_array(text, {rx}) AS gaps
                                FROM {source} WHERE regexp_matches(text, {rx})))
                    WINDOW w AS (PARTITION BY {keys} ORDER BY k))""")
        elif rule.id not in multiline and only != "multi":
            rx = quoted(bounded(rule.pattern))
            parts.append(f"""
              SELECT {keys}, {i} AS rule_idx, line_number, line, unnest(regexp_extract_all(line, {rx}, 1)) AS match
              FROM lines WHERE regexp_matches(line, {rx})""")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


_WS = "' ' || chr(9) || chr(13)"


def valid_value(value: str, least: int = 4, extra: list[str] = ()) -> str:
    v = f"trim(trim({value}, {_WS}), chr(39) || '\"` ')"
    low = f"lower({v})"
    starts = " OR ".join(f"starts_with({low}, {quoted(p)})" for p in V.FALSE_STARTS + V.ARTICLES)
    ends = " OR ".join(f"ends_with({low}, {quoted(p)})" for p in V.FALSE_ENDS)
    stops = one_of([*V.STOP_VALUES, *(e.lower() for e in extra)])
    return f"""(length({v}) >= {least} AND {low} NOT IN {stops} AND NOT ({starts}) AND NOT ({ends})
        AND NOT (regexp_matches({low}, '^https?://') AND NOT contains({low}, '@'))
        AND NOT regexp_full_match(replace(replace({v}, ':', ''), '-', ''), '\\p{{Nd}}+')
        AND len(list_distinct(string_split({v}, ''))) > 1
        AND length({v}) - length(translate({v}, '<>(){{}}|&;', '')) < 2
        AND len(list_filter(string_split_regex({v}, '\\s+'), lambda w: w <> '')) < 3)"""


def noise_line(line: str) -> str:
    word, bare = r"[\pL\pN_]", f"trim({line}, {_WS})"
    signature = V.SIGNATURE_LINE.replace(r"\w(", r"\pL\pN_(").replace(r"\w", word)
    signature = signature.replace(r"\b", r"(?:^|[^\pL\pN_])")
    tests = [V.COMMENT_LINE, V.IMPORT_LINE, V.TYPE_LINE, signature]
    return f"({bare} = '' OR " + " OR ".join(
        f"regexp_matches({bare}, {quoted(t)})" for t in tests
    ) + ")"


def keyword_hits_cte(
    keys: str, name: str = "keyword_hits", words: list[str] = KEYWORDS, case: bool = False,
    least: int = 4, extra: list[str] = (),
) -> str:
    """(keys, form, pos, line_number, line, keyword, value)."""
    alternatives = "|".join(w.replace("-", r"\-") for w in words)
    quotes = r"""(?:"([^'"\n]{1,200})"|'([^'"\n]{1,200})')"""
    parts = []
    for form, (_, shape) in enumerate(FORMS):
        rx = shape.replace("QUOTED()", quotes + "(x{0})").replace("QUOTED", quotes)
        rx = quoted(("" if case else "(?i)") + rx.replace("KEYWORD", alternatives))
        groups = ", ".join(f"unnest(regexp_extract_all(line, {rx}, {g})) AS g{g}" for g in (1, 2, 3, 4))
        parts.append(f"""
          SELECT {keys}, cast({form} AS bigint) AS form, line_number, line, {groups},
                 unnest(range(len(regexp_extract_all(line, {rx}, 1)))) AS pos
          FROM lines WHERE regexp_matches(line, {rx}) AND NOT {noise_line("line")}""")
    cut = f"trim(string_split(string_split(trim(g4, {_WS}), '#')[1], '//')[1], {_WS})"
    return f"""{name} AS (
      SELECT * FROM (
        SELECT {keys}, form, pos, line_number, line, g1 AS keyword,
               CASE WHEN coalesce(g2, '') <> '' THEN trim(g2, {_WS}) WHEN coalesce(g3, '') <> '' THEN trim(g3, {_WS})
                    ELSE rtrim({cut}, chr(39) || '"`,;') END AS value
        FROM ({' UNION ALL '.join(parts)})) AS k
      WHERE {valid_value("value", least, extra)})"""


_BITS = "list_aggregate(string_split(token, ''), 'entropy')"


def _runs(keys: str, label: str, rx: str) -> str:
    rx = quoted(rx)
    return f"""
      SELECT {keys}, line_number, line, '{label}' AS kind, token, begin, begin + length(token) AS finish
      FROM (SELECT {keys}, line_number, line, token,
                   cast(sum(length(gap)) OVER (PARTITION BY {keys}, line_number ORDER BY k)
                   + coalesce(sum(length(token)) OVER (PARTITION BY {keys}, line_number ORDER BY k
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS begin
            FROM (SELECT {keys}, line_number, line, unnest(ts) AS token, unnest(gaps[1:len(ts)]) AS gap,
                         generate_subscripts(ts, 1) AS k
                  FROM (SELECT {keys}, line_number, line, regexp_extract_all(line, {rx}) AS ts,
                               regexp_split_to_array(line, {rx}) AS gaps
                        FROM lines WHERE regexp_matches(line, {rx}))))"""


def entropy_hits_cte(
    keys: str, name: str = "entropy_hits", hexes: float = 3.0, base64s: float = 4.5
) -> str:
    """(keys, line_number, line, kind, token, begin, bits)."""
    return f"""{name}_all AS (
      SELECT * FROM (
        SELECT *, round({_BITS}, 12) AS bits,
               substr(line, greatest(begin - 60, 0) + 1, least(begin, 60) + length(token)) AS seen
        FROM ({_runs(keys, "hex", "[0-9a-fA-F]{8,}")} UNION ALL {_runs(keys, "base64", "[A-Za-z0-9+/=_-]{12,}")}))
      WHERE (kind = 'hex' AND bits >= {hexes} - 1e-9
             OR kind = 'base64' AND bits >= {base64s} - 1e-9 AND regexp_matches(token, '[^0-9a-fA-F]'))
        AND NOT regexp_matches(seen, '(?i)https?://[^\\s''"<>]*$')
        AND length(token) - length(replace(token, '/', '')) < 2
        AND length(token) - length(replace(token, '-', '')) < 2),
    {name}_b AS (
      SELECT * FROM {name}_all b WHERE kind = 'base64' AND NOT EXISTS (
        SELECT 1 FROM {name}_all h
        WHERE h.kind = 'hex' AND {_same(keys, "h", "b")} AND h.line_number = b.line_number
          AND h.begin < b.finish AND b.begin < h.finish
          AND (h.bits > b.bits OR h.bits = b.bits AND length(h.token) > length(b.token)))),
    {name} AS (
      SELECT * FROM {name}_b
      UNION ALL
      SELECT * FROM {name}_all h WHERE kind = 'hex' AND NOT EXISTS (
        SELECT 1 FROM {name}_b b
        WHERE {_same(keys, "h", "b")} AND h.line_number = b.line_number
          AND h.begin < b.finish AND b.begin < h.finish))"""


def _same(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


IGNORED = r"regexp_matches(line, '(?i)credsieve\s*:\s*ignore|pragma\s*:\s*allowlist\s+secret')"
RANKS = "CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"


def rules_cte(rules: list[Rule] = BUILTIN_RULES) -> str:
    rows = ", ".join(
        f"({i}, {quoted(r.id)}, {quoted(r.name)}, {quoted(r.severity)})" for i, r in enumerate(rules)
    )
    return f"rules(rule_idx, rule_id, rule_name, severity) AS (VALUES {rows})"


def hits_ctes(source: str, keys: str, ignore: bool = True) -> str:
    """CTE ``hits``: all hits of all detectors that are not ignored, not deduplicated."""
    return f"""{lines_cte(source, keys)}, {rules_cte()}, {rule_hits_cte(source, keys)},
      {keyword_hits_cte(keys)}, {entropy_hits_cte(keys)},
      hits AS (
        SELECT * FROM (
          SELECT {keys}, 0 AS det_rank, rule_idx, 0 AS pos, rule_id, rule_name, severity, line_number, line,
                 match AS matched_text, 'PATTERN' AS detection_type, cast(NULL AS double) AS entropy
          FROM rule_hits JOIN rules USING (rule_idx)
          UNION ALL
          SELECT {keys}, 1, form, pos, 'keyword-' || lower(keyword), 'Keyword: ' || keyword, 'MEDIUM', line_number, line,
                 value, 'KEYWORD', NULL
          FROM keyword_hits
          UNION ALL
          SELECT {keys}, 2, 0, begin, 'entropy-' || kind,
                 'High-Entropy ' || CASE kind WHEN 'hex' THEN 'Hex' ELSE 'Base64' END || ' String', 'LOW',
                 line_number, line, token, 'ENTROPY', bits
          FROM entropy_hits) AS h
        WHERE {"NOT " + IGNORED if ignore else "TRUE"})"""


def first_hits_cte(keys: str, order: str = "", source: str = "hits", name: str = "findings") -> str:
    """The first hit per (keys, line, matched text)."""
    return f"""{name} AS (
      SELECT * FROM {source}
      QUALIFY row_number() OVER (
        PARTITION BY {keys}, line_number, matched_text ORDER BY {order} det_rank, rule_idx, pos) = 1)"""


def glob_regex(glob: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def matches_globs(path: str, globs: list[str]) -> str:
    rx = quoted("(?s)(?:" + "|".join(glob_regex(g) for g in globs) + ")")
    normal = f"replace({path}, chr(92), '/')"
    return f"(regexp_full_match({normal}, {rx}) OR regexp_full_match(string_split({normal}, '/')[-1], {rx}))"


def scannable(path: str, exclude: list[str] = EXCLUDED_PATHS, include: list[str] = ()) -> str:
    kept = f"NOT {matches_globs(path, exclude)}"
    return f"({matches_globs(path, include)} OR {kept})" if include else f"({kept})"


def redacted(value: str) -> str:
    return f"CASE WHEN length({value}) <= 4 THEN '***' ELSE substr({value}, 1, 4) || '***' END"


FINGERPRINT = "sha256(rule_id || ':' || path || ':' || matched_text)"
