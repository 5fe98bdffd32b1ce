"""Registered queries of the training-data operators."""
