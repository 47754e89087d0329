"""Operators that Spark doesn't have: full-text search, constrained changes of tables, plan and statistics reports."""
