"""Corpus text forensics and provenance as Spark DataFrame transforms."""
