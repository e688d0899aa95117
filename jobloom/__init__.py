"""Spark jobs for the data side of a multi-cluster batch-job platform."""
