"""planloom.streaming."""
