"""Markdown-corpus analytics as Spark DataFrame operators."""
