"""Column-level helpers and schema rules."""
