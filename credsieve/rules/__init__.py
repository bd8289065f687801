"""Detection rules."""

from credsieve.rules.builtin import BUILTIN_RULES
from credsieve.rules.model import Rule

__all__ = ["BUILTIN_RULES", "Rule"]
