"""Query specifications, the fluent builder, and their compilation to DataFrames."""
