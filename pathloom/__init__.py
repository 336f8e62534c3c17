"""Web-corpus analytics as Spark DataFrame operations."""
