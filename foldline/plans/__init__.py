"""The registered queries, and the compaction plan."""
