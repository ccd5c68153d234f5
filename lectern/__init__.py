"""Research retrieval and knowledge-graph operators on Spark DataFrames."""
