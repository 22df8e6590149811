"""Analytics over code and document collections, expressed as Spark DataFrames."""
