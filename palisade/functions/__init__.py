"""Guard engine: functions."""
