"""Scalar rules shared by every operator."""

from mendframe.functions.cells import (
    as_column_type,
    clamp01,
    fold_key,
    guess_dtype,
    is_castable,
    is_null_like,
    is_untidy,
    issue_id,
    squeeze_blanks,
    strip_blanks,
    to_number,
    values_match,
)

__all__ = [
    "as_column_type",
    "clamp01",
    "fold_key",
    "guess_dtype",
    "is_castable",
    "is_null_like",
    "is_untidy",
    "issue_id",
    "squeeze_blanks",
    "strip_blanks",
    "to_number",
    "values_match",
]
