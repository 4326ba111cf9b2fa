"""Corpus-scale analysis of writing and conversation, as Spark DataFrame programs."""
