"""Column functions built from Spark expressions; no Python runs per row."""
