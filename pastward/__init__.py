"""Point-in-time analytics on event and match tables, written for Spark."""
