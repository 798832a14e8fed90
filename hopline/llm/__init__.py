"""Operators for preparing training text at scale. Nothing else in hopline imports this package."""
