"""planloom.operators."""
