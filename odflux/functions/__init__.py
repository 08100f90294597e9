"""Column expressions: periods, text, points and plain arithmetic."""
