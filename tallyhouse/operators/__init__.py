"""Table operators: DataFrames in, DataFrames out, store_id leading."""
