"""Spark jobs for longitudinal registry analysis."""
