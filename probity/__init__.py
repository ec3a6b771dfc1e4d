"""Integrity analytics on Spark."""
