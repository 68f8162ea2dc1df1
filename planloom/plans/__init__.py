"""planloom.plans."""
