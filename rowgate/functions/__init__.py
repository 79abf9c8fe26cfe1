"""Column expressions: text, JSON, and the compiled row checks."""
