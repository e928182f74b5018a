"""Store analytics on Spark."""
