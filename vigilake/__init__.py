"""Deterministic guardrail analytics over agent actions, expressed as Spark jobs."""
