"""emberlog: a log store and search engine on Spark DataFrames."""
