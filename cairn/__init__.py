"""A Spark-first engine for governed text memories: retrieval, lifecycle, provenance and usage analytics."""
