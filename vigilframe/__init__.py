"""Correlated, scored and versioned incident history over landed event feeds, on Spark."""
