"""Corpus text-quality analytics on Spark."""
