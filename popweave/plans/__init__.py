"""Jobs: the analyses a user runs, composed from the operators. All take and return DataFrames."""
