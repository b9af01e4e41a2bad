"""Feed and web-library analytics on Spark."""
