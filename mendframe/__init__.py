"""Data-quality audit and repair for Spark tables."""
