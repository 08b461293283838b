"""Catalogue and content-matching analytics on Spark."""
