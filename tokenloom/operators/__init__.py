"""Models, encodings and their operators on DataFrames."""
