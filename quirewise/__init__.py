"""Document-corpus operators for Spark: every tool is a function from DataFrames to DataFrames."""
