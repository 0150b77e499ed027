"""Spark jobs that turn collections of document text into analysis tables."""
