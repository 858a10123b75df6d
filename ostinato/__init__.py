"""Symbolic performance analytics as Spark DataFrame programs."""
