"""sorbus: least-squares absorption of high-cardinality effects on Spark DataFrames."""
