"""Document retrieval and retrieval-augmented-generation evaluation on Spark DataFrames."""
