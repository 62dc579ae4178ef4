"""Job-market and technology-trend analytics on Spark DataFrames."""
