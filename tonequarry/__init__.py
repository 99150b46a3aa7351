"""Spark-first operators for document tone, event studies and panel regressions."""
