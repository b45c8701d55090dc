"""Scalar functions on text, JSON and shell commands."""
