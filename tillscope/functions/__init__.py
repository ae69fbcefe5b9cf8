"""Column helpers. Everything here is a native Spark expression."""
