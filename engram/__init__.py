"""Memory analytics on Spark."""
