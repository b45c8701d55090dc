"""Reading transcripts, and tables that all executors can see."""
