"""kinweave: family-graph analysis with explicit uncertainty, and corpus preparation, on Spark DataFrames."""
