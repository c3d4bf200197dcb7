"""Readers and the logical tables derived from stored ones."""
