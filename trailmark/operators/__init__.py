"""Analytics operators: pure functions of DataFrames returning DataFrames."""
