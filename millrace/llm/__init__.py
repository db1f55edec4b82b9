"""Operators that prepare training data: one module for each."""
