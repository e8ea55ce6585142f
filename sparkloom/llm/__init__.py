"""Operators for large text and vector corpora: dedup, packing, scoring, search."""
