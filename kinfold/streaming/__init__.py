"""Incremental entry points. The grouping operators are batch-only: every run
computes its own groups, so there is no stream operator to express here."""
