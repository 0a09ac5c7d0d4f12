"""Tables as DataFrames."""
