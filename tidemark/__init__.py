"""Event-to-impact analytics on Spark."""
