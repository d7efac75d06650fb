"""Mutation-burden analytics as PySpark DataFrame operators."""
