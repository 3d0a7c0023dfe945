"""Population drift and segment root-cause analytics on Spark DataFrames."""
