"""Fixtures of the training-data operators."""
