"""Column functions: analysis, scoring, routing."""
