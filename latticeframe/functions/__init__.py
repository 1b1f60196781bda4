"""Column functions: what an operator does to one element."""
