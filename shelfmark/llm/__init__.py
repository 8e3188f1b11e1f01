"""Operators that prepare training text, one module each; queries and SQL are in ``catalog``."""
