"""Batch and streaming jobs for conversation data on Spark."""
