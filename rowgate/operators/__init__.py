"""Operators: DataFrame in, DataFrame out."""

from .batches import number_rows, row_batches, score_requests
from .generation import batch_audit, batch_table, generation_requests, require_complete
from .merge import (
    accepted,
    dedupe_rows,
    key_of,
    mark_first,
    merge_inputs,
    merge_metrics,
    merge_rows,
    rejected,
)
from .reports import axis_coverage, batch_targets, chunk_overlap, chunk_pairs, issue_profile, policy_filter, source_repeats
from .responses import (
    explode_samples,
    explode_verdicts,
    parse_payload,
    repair_message,
    repair_requests,
    with_samples,
    with_verdicts,
)
from .scoring import run_scorer
from .validate import is_valid, split_rejects, typed_projection, validate_rows
from .verdicts import align_verdicts, apply_verdicts, gate_metrics, quality_gate

__all__ = [
    "source_repeats",
    "policy_filter",
    "issue_profile",
    "chunk_overlap",
    "chunk_pairs",
    "batch_targets",
    "axis_coverage",
    "accepted",
    "align_verdicts",
    "apply_verdicts",
    "batch_audit",
    "batch_table",
    "dedupe_rows",
    "explode_samples",
    "explode_verdicts",
    "gate_metrics",
    "generation_requests",
    "is_valid",
    "key_of",
    "mark_first",
    "merge_inputs",
    "merge_metrics",
    "merge_rows",
    "number_rows",
    "parse_payload",
    "quality_gate",
    "rejected",
    "repair_message",
    "repair_requests",
    "require_complete",
    "row_batches",
    "run_scorer",
    "score_requests",
    "split_rejects",
    "typed_projection",
    "validate_rows",
    "with_samples",
    "with_verdicts",
]
