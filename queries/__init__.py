"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from .common import Entry


def catalog() -> dict[str, Entry]:
    from . import checks, files, merging, reports, responses, scoring

    return {
        **merging.QUERIES,
        **checks.QUERIES,
        **responses.QUERIES,
        **scoring.QUERIES,
        **files.QUERIES,
        **reports.QUERIES,
    }
