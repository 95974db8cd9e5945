"""Guard engine: streaming."""
