"""Column-level data provenance and training-data preparation as Spark jobs."""
