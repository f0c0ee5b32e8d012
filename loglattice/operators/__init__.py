"""DataFrame-level operators built from the column functions."""
