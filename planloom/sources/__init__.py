"""planloom.sources."""
