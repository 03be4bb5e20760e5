"""Operators for preparing text training data from recordings."""
