"""Document-graph retrieval, analytics and training-data operators over Spark DataFrames."""
