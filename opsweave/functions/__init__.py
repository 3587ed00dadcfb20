"""Column-level helpers: pure Catalyst expressions, no Python UDFs."""
