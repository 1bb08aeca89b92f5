"""Where the rows of a store come from."""
