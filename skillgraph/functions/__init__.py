"""Column functions and shared relational helpers."""
