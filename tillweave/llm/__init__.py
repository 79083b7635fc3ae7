"""Operators for preparing training data; see README."""
