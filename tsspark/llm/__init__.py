"""Operators for preparing text for training: filters, duplicates, leaks, secrets, personal data, scores, tokens."""
