"""Incremental versions of the rollup and of the row checks."""
