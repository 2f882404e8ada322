"""Stateful stream versions of batch operators."""
