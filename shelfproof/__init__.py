"""Trust-aware product listings as Spark DataFrame jobs."""
