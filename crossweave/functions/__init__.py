"""Column functions of the panel toolkit."""
