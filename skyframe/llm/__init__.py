"""Training-data operators: ten corpus jobs, each a function from DataFrames to a DataFrame."""
