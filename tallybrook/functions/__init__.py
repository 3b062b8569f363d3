"""Scalar functions: hashing, byte formatting, parsing."""
