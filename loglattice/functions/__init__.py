"""Column-level building blocks: every function here maps Columns to a Column."""
