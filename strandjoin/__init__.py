"""Short-read alignment and its analyses as Spark DataFrame operations."""
