"""Column and window expressions."""
