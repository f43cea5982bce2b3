"""Analytics operators: DataFrames and plain values in, a DataFrame out."""
