"""Batch operators on conversation tables."""
