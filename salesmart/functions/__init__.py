"""Column builders; all of them are built-in Spark expressions."""
