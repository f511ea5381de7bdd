"""Research-integrity analytics on Spark."""
