"""Column functions and vectorised functions on text."""
