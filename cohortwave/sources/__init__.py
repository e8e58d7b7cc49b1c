"""Readers and guarded writers."""
