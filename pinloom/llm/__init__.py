"""Operators for training data from source corpora. Nothing outside this folder imports it."""
