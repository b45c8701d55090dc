"""Lossless compaction, retrieval and analysis of JSON-Lines agent transcripts on Spark."""
