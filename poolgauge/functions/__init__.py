"""Column functions and fixed values of the panel."""
