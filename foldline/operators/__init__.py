"""Reusable dataflow operators over ordered records."""
