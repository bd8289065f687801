"""A detection rule as the plan builder needs it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from credsieve.functions.entropy import BASE64_CHARS
from credsieve.functions.regex import (
    Untranslatable,
    char_class,
    guaranteed_run,
    stays_in_run,
    to_java,
)

# Tokens are long runs of these characters, and prose and markup have few such runs.  They
# are taken out of a text once; most rules then look at them instead of at the text.
RUN_CHARS = BASE64_CHARS + ".:"
RUN_LENGTH = 20
LONG_RUN = f"(?<!{char_class(RUN_CHARS)}){char_class(RUN_CHARS)}{{{RUN_LENGTH},}}"


@dataclass(frozen=True)
class Rule:
    """``literals``: every match holds at least one of them (none = unknown).

    With ``any_case`` the literals are compared without regard to case.
    """

    id: str
    name: str
    severity: str
    pattern: str
    literals: list[str] = field(default_factory=list, compare=False)
    any_case: bool = False
    description: str = ""

    @cached_property
    def java(self) -> str | None:
        """The pattern for Spark, or None if only Python can run it."""
        try:
            return to_java(self.pattern)
        except Untranslatable:
            return None

    @cached_property
    def has_long_run(self) -> bool:
        """True if every match holds a run that LONG_RUN finds."""
        return guaranteed_run(self.pattern, RUN_CHARS) >= RUN_LENGTH

    @cached_property
    def is_long_run(self) -> bool:
        """True if it is enough to look at what LONG_RUN finds."""
        return self.has_long_run and stays_in_run(self.pattern, RUN_CHARS)
