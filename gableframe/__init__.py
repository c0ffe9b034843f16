"""Property-market analytics as PySpark DataFrame functions."""
