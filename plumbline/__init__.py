"""Spark jobs that run, clean, grade and record analytical answers in bulk."""
