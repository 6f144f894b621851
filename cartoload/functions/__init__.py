"""Column functions: names, types, values and geometry."""
