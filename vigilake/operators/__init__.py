"""Operators from DataFrame to DataFrame, for batches and streams alike."""
