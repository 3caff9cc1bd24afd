"""Readers and writers of the operational tables."""
