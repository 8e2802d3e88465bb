"""Text tokenization and training-data preparation on Spark DataFrames."""
