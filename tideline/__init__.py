"""Timeline and corpus analytics expressed with Spark DataFrames."""
