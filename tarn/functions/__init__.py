"""Functions over rows, as Column expressions."""
