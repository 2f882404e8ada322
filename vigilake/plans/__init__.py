"""Registered queries and their oracle SQL, by subject."""
