"""Spark jobs on tables."""
