"""Structural code-quality analytics expressed as Spark DataFrame operators."""
