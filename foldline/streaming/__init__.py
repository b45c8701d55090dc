"""Live sessions: routing of lifecycle events and the incremental archive."""
