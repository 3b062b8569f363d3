"""Streaming forms: filters by row, and folds of what has come so far."""
