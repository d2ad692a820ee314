"""Operators of the ledger: folds of the log, and set operations on paths."""
