"""DataFrame -> DataFrame operations."""
