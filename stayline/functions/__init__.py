"""Column expressions: dates and windows, labels, guarded arithmetic."""
