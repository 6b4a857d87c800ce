"""Content-addressed storage analytics on Spark."""
