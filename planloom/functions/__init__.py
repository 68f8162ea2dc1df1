"""planloom.functions."""
