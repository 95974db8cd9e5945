"""Guard engine: plans."""
