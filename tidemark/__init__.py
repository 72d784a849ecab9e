"""tidemark: a time-series query engine expressed in Spark DataFrames."""
