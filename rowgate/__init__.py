"""Check, score, dedupe and merge rows of JSON or typed tables with Spark."""

from .operators import *  # noqa: F401,F403
from .plans import TEXT_COMPRESSION, Axis, CodeRule, Plan, Profile
from .session import clear_staging, configure, session, stage
from .sinks import *  # noqa: F401,F403
from .sources import *  # noqa: F401,F403
from .streaming import merge_arrivals

__all__ = [
    "Axis",
    "CodeRule",
    "Plan",
    "Profile",
    "TEXT_COMPRESSION",
    "clear_staging",
    "configure",
    "merge_arrivals",
    "session",
    "stage",
]
