"""Operators that prepare training data: one module each, queries in ``queries``."""
