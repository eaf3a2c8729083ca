"""Spark jobs for household travel surveys and other diary-like data."""
