"""Operators for preparing training data: one module per operator, ``queries``
registers them. Nothing else in the library imports this package."""
