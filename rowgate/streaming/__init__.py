"""Structured Streaming: merging chunks as they arrive."""

from .arrivals import merge_arrivals, merge_batch, read_arriving_lines

__all__ = ["merge_arrivals", "merge_batch", "read_arriving_lines"]
