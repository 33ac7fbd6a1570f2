"""Checks and analytics for corpora of Markdown and HTML documents, on Spark DataFrames."""
