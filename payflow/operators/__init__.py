"""Reusable DataFrame operators (windows, global ranks, joins, folds, SCD2, checks)."""
