"""Column functions that Spark lacks."""
