"""Which paths are scanned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.globs import globs_to_regex
from credsieve.functions.text import base_name, normal_path
from credsieve.options import EXCLUDED_PATHS, ScanOptions


def matches_globs(path: Column, globs: list[str]) -> Column:
    """True if the whole path or its last part matches one of the globs."""
    regex, normal = globs_to_regex(globs), normal_path(path)
    return normal.rlike(regex) | base_name(normal).rlike(regex)


def should_scan(path: Column, options: ScanOptions | None = None) -> Column:
    """Includes win over excludes; an empty exclude list means the default one."""
    options = options or ScanOptions()
    kept = ~matches_globs(path, options.exclude_paths or EXCLUDED_PATHS)
    if options.include_paths:
        kept = matches_globs(path, options.include_paths) | kept
    return kept


def path_of_url(url: Column) -> Column:
    """Path part of an address, without query and fragment."""
    return F.regexp_extract(url, r"\A[^:]*://[^/?#]*/?([^?#]*)", 1)
