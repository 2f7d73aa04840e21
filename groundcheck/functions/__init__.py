"""Column expressions: projections, geometry, pixels, text."""
