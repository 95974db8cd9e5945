"""Guard engine: operators."""
