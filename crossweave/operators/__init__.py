"""Panel operators: DataFrames keyed by (date, ticker) in, DataFrames out, all lazy."""
