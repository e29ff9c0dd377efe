"""Column- and schema-level functions."""
