"""Reading and writing tables, with declared schemas."""
