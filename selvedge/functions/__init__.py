"""Column expressions: measures, ladders, identifiers and report text."""
