"""Scalar functions on columns, with the dialect's NULL and error rules."""
