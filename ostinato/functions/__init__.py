"""Pure functions of columns."""
