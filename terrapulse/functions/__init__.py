"""Column functions. Each takes Columns (or column names) and returns a Column."""
