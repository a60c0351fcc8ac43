"""Evaluation analytics for Spark: scans, checks, grading, paired statistics and curriculum metrics."""
