"""Column expressions: names, cells and times."""
