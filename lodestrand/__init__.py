"""Lodestrand: a Spark-first engine for agent-memory and training-data workloads."""
