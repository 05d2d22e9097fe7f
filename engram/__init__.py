"""engram: long-term-memory analytics on Spark DataFrames."""
