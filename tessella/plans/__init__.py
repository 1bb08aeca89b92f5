"""From queries to lazy DataFrames."""
