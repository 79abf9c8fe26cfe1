"""Writers."""

from .writers import (
    artifacts_dir,
    code_file_table,
    json_lines_to_columnar,
    reject_records,
    write_code_files,
    write_columnar,
    write_json_lines,
    write_rows,
    write_run_artifacts,
)

__all__ = [
    "artifacts_dir",
    "code_file_table",
    "json_lines_to_columnar",
    "reject_records",
    "write_code_files",
    "write_columnar",
    "write_json_lines",
    "write_rows",
    "write_run_artifacts",
]
