"""Spark jobs over combinatorial design spaces."""
