"""Batch document retrieval, evaluation and log analytics as Spark DataFrames."""
