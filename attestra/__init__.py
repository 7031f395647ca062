"""Attestra: evidence and document-quality analytics as Spark plans."""
