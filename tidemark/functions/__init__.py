"""Scalar functions as Column expressions; Python only where no built-in has the function."""
