"""Options of a scan.  They shape the plan; none of them is data."""

from __future__ import annotations

from dataclasses import dataclass, field

# Keywords of the assignment detector.
KEYWORDS = [
    "api_key", "apikey", "access_key", "access_token", "auth_token", "client_secret",
    "connection_string", "conn_str", "database_url", "db_password", "db_pass", "encryption_key",
    "password", "passwd", "pwd", "private_key", "private-key", "secret", "secret_key", "token",
]

# Globs of paths that are not scanned unless included again.
EXCLUDED_PATHS = [
    # media, programs, archives, office documents
    "*.pyc", "*.pyo", "*.so", "*.dll", "*.exe", "*.bin",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.bmp", "*.webp",
    "*.woff", "*.woff2", "*.ttf", "*.eot", "*.mp3", "*.mp4", "*.avi", "*.mov",
    "*.zip", "*.tar.gz", "*.tgz", "*.rar", "*.7z", "*.jar", "*.war",
    "*.pdf", "*.doc", "*.docx", "*.xls", "*.xlsx",
    # lock files, generated files, examples
    "*.min.js", "*.min.css", "*.map", "*.lock",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock",
    "Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum", "go.work.sum", "*.sum",
    "*.schema.json", "*.example", "*.sample", "*.template",
    ".env.example", ".env.sample", ".env.template",
    # top-level directories
    "node_modules/*", ".git/*", "vendor/*", "__pycache__/*", ".venv/*", "venv/*",
    ".tox/*", ".mypy_cache/*", "dist/*", "build/*", ".eggs/*", "target/*",
]

MAX_FILE_SIZE = 5 * 1024 * 1024
SNIFFED_BYTES = 8192

# Python dialect, any case; lines that match are not reported.
IGNORE_MARKERS = [r"credsieve\s*:\s*ignore", r"pragma\s*:\s*allowlist\s+secret"]


@dataclass(frozen=True)
class ScanOptions:
    """What is detected, what is left out and how findings are judged."""

    # detection
    use_builtin_rules: bool = True
    use_keywords: bool = True
    use_entropy: bool = True
    hex_threshold: float = 3.0
    base64_threshold: float = 4.5
    keywords: list[str] = field(default_factory=lambda: list(KEYWORDS))
    keyword_case_sensitive: bool = False
    min_value_length: int = 4
    extra_stop_values: list[str] = field(default_factory=list)
    ignore_markers: list[str] = field(default_factory=lambda: list(IGNORE_MARKERS))
    # files
    max_file_size: int = MAX_FILE_SIZE
    exclude_paths: list[str] = field(default_factory=list)
    include_paths: list[str] = field(default_factory=list)
    # revisions; the first one set wins: pending, head_only, diff_base, since_commit
    pending: bool = False
    head_only: bool = False
    diff_base: str | None = None
    since_commit: str | None = None
    # judgement and output
    min_severity: str = "LOW"
    fail_on_severity: str | None = None
    redact: bool = False
