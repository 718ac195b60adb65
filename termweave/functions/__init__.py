"""Column to Column functions, built-ins only."""
