"""Operators for training-data pipelines: documents and pages in, decisions and files out."""

from __future__ import annotations

from .queries import catalog

__all__ = ["catalog"]
