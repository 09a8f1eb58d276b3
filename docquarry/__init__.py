"""Fielded search and time-indexed document analytics as Spark DataFrame plans."""
