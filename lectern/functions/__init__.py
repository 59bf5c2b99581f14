"""Column expressions: every function here takes Columns and returns a Column."""
