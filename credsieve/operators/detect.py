"""The detectors as one narrow pass over a table of texts.

A text is read once.  Cheap gates decide which detectors look at it; the lines they
care about are exploded, the matches of a line are exploded again, and only findings
leave the pass.  Nothing is shuffled before :func:`first_per_line`, which groups
findings, never texts.
"""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.functions.findings import severity_rank
from credsieve.functions.regex import to_java
from credsieve.functions.text import drop_line_end, text_array
from credsieve.functions.values import is_noise_line, is_valid_secret
from credsieve.operators import entropy, keywords, patterns
from credsieve.operators.rule_table import table_hits
from credsieve.options import ScanOptions
from credsieve.rules import BUILTIN_RULES, Rule
from credsieve.rules.model import RUN_LENGTH

PATTERN, KEYWORD, ENTROPY = 0, 1, 2
# a text that was looked at, with or without hits
SEEN = -1
# columns added to the key columns of the input
HIT_COLUMNS = [
    "rule_id", "rule_name", "severity", "sev_rank", "line_number", "line_content",
    "matched_text", "detection_type", "entropy", "det_rank", "rule_idx", "pos",
]

_LINE = "array<struct<det:int,rule_idx:int,line_number:int,line:string,match:string,pos:int>>"
_PART = "array<struct<rule_idx:int,pos:bigint,extra:string,value:string>>"
_TOKEN = "array<struct<encoding:string,bits:double,token:string>>"


def is_ignored(line: Column, options: ScanOptions) -> Column:
    """True if the line carries one of the inline markers."""
    if not options.ignore_markers:
        return F.lit(False)
    return line.rlike(to_java("|".join(f"(?:{m})" for m in options.ignore_markers), True))


def active_rules(options: ScanOptions, custom_rules: list[Rule] = ()) -> list[Rule]:
    """Built-in rules first, custom rules after them."""
    return [*(BUILTIN_RULES if options.use_builtin_rules else []), *custom_rules]


def raw_hits(
    texts: DataFrame,
    keys: list[str],
    text: str = "text",
    options: ScanOptions | None = None,
    custom_rules: list[Rule] | DataFrame = (),
    seen: bool = False,
    first_only: bool = False,
) -> DataFrame:
    """Every hit of every detector: the key columns and HIT_COLUMNS.

    Hits are not deduplicated; (det_rank, rule_idx, pos) is their order within a line.
    With ``seen`` every text has one more row, of det_rank SEEN, so the pass itself tells
    which texts it has read.
    ``custom_rules`` may be rule rows: they stay a table, and the texts are read a second
    time for them (see ``rule_table``).  With ``first_only`` a matched text of a line needs
    to be there only for the first of those rules.
    """
    options = options or ScanOptions()
    if isinstance(custom_rules, DataFrame):
        own = table_hits(
            _computed_once(texts, keys, text), keys, custom_rules, len(active_rules(options)), first_only=first_only
        )
        own = own.where(~is_ignored(F.col("line_content"), options))
        if not (options.use_builtin_rules or options.use_keywords or options.use_entropy):
            if not seen:
                return own
        return raw_hits(texts, keys, text, options, seen=seen).unionByName(own)
    rules = list(enumerate(active_rules(options, custom_rules)))
    texts = _computed_once(texts, keys, text)
    lines = _candidate_lines(texts, keys, options, [(i, r) for i, r in rules if r.java], seen)
    python_rules = [(i, r) for i, r in rules if not r.java]
    if python_rules:
        found = patterns.python_matches(texts, keys, python_rules)
        found = found.where(~is_ignored(F.col("line"), options))
        lines = lines.unionByName(found.withColumn("det", F.lit(PATTERN)))
    return _finished(_tokens(_parts(lines, keys, options), keys, options), keys, [r for _, r in rules])


def _computed_once(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, _text).  The optimizer moves filters below projections by repeating the
    projected expressions in them; a text that is decoded or put together would then be
    computed again for every gate.  It does not do so below a generator.
    """
    return texts.where(F.col(text).isNotNull()).select(
        *keys, F.explode(F.array(F.col(text))).alias("_text")
    )


def _any_gate(options: ScanOptions, rules: list[tuple[int, Rule]]) -> Column:
    """True if some detector may have a hit in ``_text``."""
    text, in_runs, gates = F.col("_text"), [], []
    if options.use_keywords:
        gates.append(keywords.keyword_gate(text, options))
    if options.use_entropy:
        gates.append(text.rlike(entropy.hex_pattern(options)))
        if entropy.base64_size(options) >= RUN_LENGTH:
            in_runs.append(entropy.base64_pattern(options))
        else:
            gates.append(text.rlike(entropy.base64_pattern(options)))
    gates.append(patterns.any_rule("_text", [r for _, r in rules], in_runs))
    return functools.reduce(Column.__or__, gates)


def _candidate_lines(
    texts: DataFrame, keys: list[str], options: ScanOptions, rules: list[tuple[int, Rule]], seen: bool = False
) -> DataFrame:
    text = F.col("_text")
    gate = _any_gate(options, rules)
    if seen:
        # texts without hits go on for the sake of their mark, with all else left undone
        texts, gate = texts.select(*keys, "_text", gate.alias("_gate")), F.lit(True)
    flags = {}
    if options.use_keywords:
        flags["_keyword"] = keywords.keyword_gate(text, options)
    if options.use_entropy:
        flags["_entropy"] = text.rlike(entropy.token_pattern(options))
    def if_open(value: Column, closed: Column) -> Column:
        return F.when(F.col("_gate"), value).otherwise(closed) if seen else value

    no_rules = F.array().cast("array<int>")
    gated = texts.where(gate).select(
        *keys,
        "_text",
        (if_open(patterns.applying_rules("_text", rules), no_rules) if rules else no_rules).alias("_rules"),
        if_open(patterns.match_mark(text), F.lit("")).alias("_mark"),
        *[if_open(flag, F.lit(False)).alias(name) for name, flag in flags.items()],
    )
    parts = []
    if rules:
        indexes = F.expr("array(" + ", ".join(str(i) for i, _ in rules) + ")")
        by_index = F.map_from_arrays(indexes, text_array([r.java for _, r in rules]))

        def of_rule(i: Column) -> Column:
            found = patterns.located_matches(
                text, F.col("_mark"), F.element_at(by_index, i), lambda line: is_ignored(line, options)
            )
            lines = F.transform(F.split(text, "\n", -1), drop_line_end)

            def with_line(all_lines: Column) -> Column:
                return F.transform(
                    found,
                    lambda m: F.struct(
                        F.lit(PATTERN).alias("det"), i.alias("rule_idx"), m["line_number"],
                        F.element_at(all_lines, m["line_number"]).alias("line"), m["match"], m["pos"],
                    ),
                )

            # the lambda gives the lines a name, so that the text is cut once
            return F.flatten(F.transform(F.array(lines), with_line))

        parts.append(F.flatten(F.transform(F.col("_rules"), of_rule)).cast(_LINE))

    def whole_lines(det: int, flag: str, rows: Column) -> Column:
        nothing = F.array().cast(_LINE)
        return F.when(
            F.col(flag),
            F.transform(
                rows,
                lambda r: F.struct(
                    F.lit(det).alias("det"), F.lit(0).alias("rule_idx"), r["line_number"],
                    r["line"], F.lit("").alias("match"), F.lit(0).alias("pos"),
                ),
            ).cast(_LINE),
        ).otherwise(nothing)

    if "_keyword" in flags:
        parts.append(whole_lines(KEYWORD, "_keyword", keywords.keyword_lines(text, options)))
    if "_entropy" in flags:
        parts.append(whole_lines(ENTROPY, "_entropy", entropy.token_lines(text, options)))
    if seen:
        fields = {"det": F.lit(SEEN), "rule_idx": F.lit(0), "line_number": F.lit(0), "line": F.lit(""), "match": F.lit(""), "pos": F.lit(0)}
        parts.append(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])).cast(_LINE))
    rows = F.concat(*parts) if parts else F.array().cast(_LINE)
    lines = gated.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")
    # matches on ignored lines are left out already
    return lines.where((F.col("det") == PATTERN) | ~is_ignored(F.col("line"), options))


def _parts(lines: DataFrame, keys: list[str], options: ScanOptions) -> DataFrame:
    """Pattern matches as they are, assignments of keyword lines, runs of entropy lines."""
    det, line = F.col("det"), F.col("line")
    match = F.array(
        F.struct(F.col("rule_idx"), F.col("pos").cast("bigint"), F.lit(""), F.col("match"))
    ).cast(_PART)
    assignments = F.transform(
        keywords.line_assignments(line, options),
        lambda a: F.struct(a["form"], a["pos"].cast("bigint"), a["keyword"], a["value"]),
    ).cast(_PART)
    runs = F.transform(
        entropy.line_runs(line, options),
        lambda r: F.struct(F.lit(0), r["pos"].cast("bigint"), r["head"], r["run"]),
    ).cast(_PART)
    parts = F.when(det.isin(PATTERN, SEEN), match)
    if options.use_keywords:
        lines = lines.where((det != KEYWORD) | ~is_noise_line(line))
        parts = parts.when(det == KEYWORD, assignments)
    if options.use_entropy:
        parts = parts.when(det == ENTROPY, runs)
    out = lines.select(*keys, "det", "line_number", "line", F.explode(parts).alias("p")).select(
        *keys, "det", "line_number", "line", "p.*"
    )
    if options.use_keywords:
        plausible = is_valid_secret(
            F.col("value"), options.min_value_length, options.extra_stop_values
        )
        out = out.where((det != KEYWORD) | plausible)
    return out


def _tokens(parts: DataFrame, keys: list[str], options: ScanOptions) -> DataFrame:
    """Runs become the tokens reported of them; everything else passes."""
    if not options.use_entropy:
        return parts.withColumn("bits", F.lit(None).cast("double"))
    is_run, head, run = F.col("det") == ENTROPY, F.col("extra"), F.col("value")
    measured = parts.select(
        "*",
        F.when(is_run, entropy.base64_bits(head, run, options)).alias("_bits"),
        F.when(is_run, entropy.hex_tokens(head, run, options)).alias("_hexes"),
    )
    passed = F.array(F.struct(F.col("extra"), F.lit(None).cast("double"), F.col("value")))
    tokens = F.when(
        is_run, entropy.run_tokens(F.col("_bits"), F.col("_hexes"), run).cast(_TOKEN)
    ).otherwise(passed.cast(_TOKEN))
    return measured.select(
        *keys, "det", "line_number", "line", "rule_idx", "pos", F.posexplode(tokens).alias("_sub", "t")
    ).select(
        *keys, "det", "line_number", "line", "rule_idx",
        # hex tokens of one run keep their order
        (F.shiftleft(F.col("pos"), 31) + F.col("_sub")).alias("pos"),
        F.col("t.encoding").alias("extra"), F.col("t.token").alias("value"), F.col("t.bits").alias("bits"),
    )


def _finished(hits: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    det, extra = F.col("det"), F.col("extra")

    def of_rule(values: list[str]) -> Column:
        if not rules:
            return F.lit(None)
        return F.element_at(text_array(values), F.col("rule_idx") + 1)

    def pick(pattern: Column, keyword: Column, token: Column) -> Column:
        return F.when(det == PATTERN, pattern).when(det == KEYWORD, keyword).otherwise(token)

    severity = pick(of_rule([r.severity for r in rules]), F.lit("MEDIUM"), F.lit("LOW"))
    return hits.select(
        *keys,
        pick(
            of_rule([r.id for r in rules]),
            F.concat(F.lit("keyword-"), F.lower(extra)),
            F.concat(F.lit("entropy-"), extra),
        ).alias("rule_id"),
        pick(
            of_rule([r.name for r in rules]),
            F.concat(F.lit("Keyword: "), extra),
            F.concat(F.lit("High-Entropy "), F.initcap(extra), F.lit(" String")),
        ).alias("rule_name"),
        severity.alias("severity"),
        severity_rank(severity).alias("sev_rank"),
        F.col("line_number"),
        F.col("line").alias("line_content"),
        F.col("value").alias("matched_text"),
        pick(F.lit("PATTERN"), F.lit("KEYWORD"), F.lit("ENTROPY")).alias("detection_type"),
        F.col("bits").alias("entropy"),
        det.alias("det_rank"),
        F.col("rule_idx"),
        F.col("pos").cast("bigint").alias("pos"),
    )


def first_per_line(hits: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """One hit per (keys, line, matched text): the first by ``order``, then by detector,
    rule and position."""
    group = [*keys, "line_number", "matched_text"]
    rank = [*order, "det_rank", "rule_idx", "pos"]
    rest = [c for c in hits.columns if c not in group and c not in rank]
    # the order columns lead the struct, so its minimum is the first hit
    first = F.min(F.struct(*rank, *rest)).alias("f")
    return (
        hits.groupBy(*group)
        .agg(first)
        .select(*[F.col(c) if c in group else F.col(f"f.{c}").alias(c) for c in hits.columns])
    )


def detect(
    texts: DataFrame,
    keys: list[str],
    text: str = "text",
    options: ScanOptions | None = None,
    custom_rules: list[Rule] | DataFrame = (),
    seen: bool = False,
) -> DataFrame:
    """Findings of a table of texts; ``keys`` name a text (repository, path, ...).

    ``seen`` adds a row of det_rank SEEN for each text, as ``raw_hits`` does.
    """
    return first_per_line(raw_hits(texts, keys, text, options, custom_rules, seen, first_only=True), keys)


def scan_lines(
    lines: DataFrame,
    keys: list[str],
    line: str = "line",
    options: ScanOptions | None = None,
    custom_rules: list[Rule] = (),
) -> DataFrame:
    """All rule matches in a table of single lines: keys, rule_id, rule_name, severity,
    line_content, matched_text, start and end.

    The lines bring their own numbers among the ``keys``.  Every match is a row, repeats on
    a line too; inline markers are not looked at.  start and end count characters from 0.
    """
    rules = list(enumerate(active_rules(options or ScanOptions(), custom_rules)))
    java, others = [(i, r) for i, r in rules if r.java], [(i, r) for i, r in rules if not r.java]
    texts = _computed_once(lines, keys, line)
    text = F.col("_text")
    found = None
    if java:
        by_index = F.map_from_arrays(
            F.expr("array(" + ", ".join(str(i) for i, _ in java) + ")"), text_array([r.java for _, r in java])
        )
        gated = texts.where(patterns.any_rule("_text", [r for _, r in java])).select(
            *keys, "_text", patterns.match_mark(text).alias("_mark"), F.explode(patterns.applying_rules("_text", java)).alias("rule_idx")
        )
        found = gated.select(
            *keys, "_text", "rule_idx", F.inline(patterns.spans(text, F.col("_mark"), F.element_at(by_index, F.col("rule_idx"))))
        )
    if others:
        more = patterns.python_spans(texts, keys, others)
        found = more if found is None else found.unionByName(more)
    if found is None:
        raise ValueError("no rules to look for")

    def of_rule(values: list[str]) -> Column:
        return F.element_at(text_array(values), F.col("rule_idx") + 1)

    return found.select(
        *keys,
        of_rule([r.id for _, r in rules]).alias("rule_id"),
        of_rule([r.name for _, r in rules]).alias("rule_name"),
        of_rule([r.severity for _, r in rules]).alias("severity"),
        text.alias("line_content"),
        F.col("match").alias("matched_text"),
        "start",
        "end",
    )


def assignments(
    texts: DataFrame, keys: list[str], text: str = "text", options: ScanOptions | None = None
) -> DataFrame:
    """Keyword assignments alone: (keys, line_number, line_content, form, keyword, value).

    Per line one row for each (keyword in lower case, value), in the first form that
    finds it; inline markers are not looked at.
    """
    options = replace(
        options or ScanOptions(), use_builtin_rules=False, use_entropy=False, ignore_markers=[]
    )
    texts = _computed_once(texts, keys, text)
    found = _parts(_candidate_lines(texts, keys, options, []), keys, options)
    word = F.lower("extra").alias("_word")
    first = F.min(F.struct("rule_idx", "pos", "extra", "line")).alias("f")
    return (
        found.groupBy(*keys, "line_number", word, "value")
        .agg(first)
        .select(
            *keys,
            "line_number",
            F.col("f.line").alias("line_content"),
            F.col("f.rule_idx").alias("form"),
            F.col("f.extra").alias("keyword"),
            "value",
        )
    )
