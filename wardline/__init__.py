"""Discharge analytics as Spark jobs: ingest, clean, score, aggregate, tag, estimate."""
