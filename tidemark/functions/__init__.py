"""Column functions that several operators use."""
