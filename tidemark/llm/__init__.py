"""Operators for training-corpus preparation. Nothing else in the package imports this one."""
