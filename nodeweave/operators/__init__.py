"""Graph operators on DataFrames: hops, paths, search, eager fetch and mutations."""
