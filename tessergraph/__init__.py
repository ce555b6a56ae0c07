"""Property-graph building, entity resolution and path mining on Spark DataFrames."""
