"""Spark jobs for code-convention checks, hybrid retrieval and corpus preparation."""
