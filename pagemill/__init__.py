"""Markdown corpus builder for Spark."""
