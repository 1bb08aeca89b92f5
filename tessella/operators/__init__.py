"""What is done with a store beside queries: output forms, changes, channels, contents, paths and sessions."""
