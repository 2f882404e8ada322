"""See the module docstrings of this package."""
