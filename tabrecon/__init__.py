"""tabrecon — reconcile and reshape tables on Spark DataFrames.

Key-membership joins (subtract / intersect with not-found), first-match enrichment,
schema-tolerant stacking with keep-first dedup, row extraction by text / number /
emptiness conditions, and splits by column values, line count or source — all as
lazy DataFrame plans with exact handling of nulls, blanks, whitespace and numeric text.
"""

from .functions.predicates import CONDITIONS, predicate
from .functions.text import normalize_key, text_form, to_number
from .functions.tokens import group_token
from .operators.enrich import enrich, fill_nulls
from .operators.extract import extract
from .operators.membership import (
    Result,
    intersect,
    membership_many_a,
    membership_many_b,
    intersect_many,
    not_found,
    subtract,
    subtract_many,
    with_file_sets,
)
from .operators.order import first_per_key, with_file_order
from .operators.split import line_numbers, manifest, split_by_columns, split_by_lines, split_by_source, split_manifest
from .operators.stack import combine, reconcile_types, stack
from .plans.job import from_profile, run_job
from .plans.sheets import as_sheets
from .plans.stats import membership_stats, preview, run_stats
from .session import build_session, checkpoint_dir
from .sinks.export import export, project, read_export, write_split
from .sinks.workbook import as_workbooks
from .sources.csv import read_csv
from .sources.scan import read_many, read_table, scan, scan_paths, scan_tables, scan_workbooks
from .sources.workbook import combine_sheets, parse_workbooks, read_all_sheets, read_workbooks, select_sheet

__all__ = [
    "CONDITIONS", "Result", "as_sheets", "as_workbooks", "build_session", "checkpoint_dir", "combine", "combine_sheets", "enrich", "export",
    "extract", "fill_nulls", "first_per_key", "from_profile", "group_token", "intersect", "intersect_many", "line_numbers", "manifest",
    "membership_many_a", "membership_many_b", "membership_stats", "normalize_key", "not_found", "parse_workbooks", "predicate", "preview", "project",
    "read_all_sheets", "read_csv", "read_export", "read_many", "read_table", "read_workbooks", "reconcile_types", "run_job", "run_stats",
    "scan", "scan_paths", "scan_tables", "scan_workbooks", "select_sheet", "split_by_columns", "split_by_lines", "split_by_source", "split_manifest",
    "stack", "subtract", "subtract_many", "text_form", "to_number", "with_file_order", "with_file_sets", "write_split",
]
