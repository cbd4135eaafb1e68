"""Column-level helpers (scalar expressions, no UDFs)."""
