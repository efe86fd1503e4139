"""Wiring of the operators to the driver's test tables, with their SQL twins."""
