"""Document-layout analytics on Spark: pages, positioned words and annotations as DataFrames."""
