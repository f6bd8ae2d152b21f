"""Operators of a text-training-data pipeline; nothing else in the package imports them."""
