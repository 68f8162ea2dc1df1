"""planloom: a closed relational plan compiled to Spark DataFrames, plus corpus operators."""

__version__ = "0.1.0"
