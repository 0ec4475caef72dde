"""Tessera: relational, streaming and text-corpus operators expressed on Spark's DataFrame API."""
