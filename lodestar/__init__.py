"""Directory search, curation and evaluation analytics on Spark."""
