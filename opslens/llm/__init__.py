"""Operators for training-data pipelines over text, tokens, vectors and conversations."""
