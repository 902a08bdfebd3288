"""Operators over message and attachment tables. All take and return DataFrames or Columns."""
