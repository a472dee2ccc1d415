"""Spark jobs over corpora of office and markup documents."""
