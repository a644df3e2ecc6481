"""Column expressions and lineage helpers."""
