"""Guard engine: sources."""
