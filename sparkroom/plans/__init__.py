"""Ordered stages, built as one plan."""
