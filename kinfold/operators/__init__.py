"""Relational building blocks: pair joins, linkage, components, ranking, shared storage."""
