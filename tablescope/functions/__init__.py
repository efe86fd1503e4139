"""Column helpers, join helpers and fixed values shared by the operators."""
