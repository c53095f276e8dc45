"""Column functions.  All are built-in Spark expressions; there is no Python UDF."""
