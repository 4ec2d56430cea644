"""Column functions: every one takes Columns and returns a Column."""
