"""Column expressions: patterns, suggestion lines, geometry, viewport, user expressions."""
