"""Plan documents and profiles."""

from .plan import Axis, Plan, schema_from_fields
from .profiles import BUILT_IN, TEXT_COMPRESSION, CodeRule, Profile, rules_of

__all__ = [
    "Axis",
    "BUILT_IN",
    "CodeRule",
    "Plan",
    "Profile",
    "TEXT_COMPRESSION",
    "rules_of",
    "schema_from_fields",
]
