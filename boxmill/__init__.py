"""Detection-data analytics on Spark."""
