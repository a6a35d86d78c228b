"""Voice-of-customer analytics on Spark."""
