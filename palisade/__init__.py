"""Guardrail analytics for agent requests, expressed over Spark DataFrames."""

__version__ = "0.1.0"
