"""Symbol analytics on Spark."""
