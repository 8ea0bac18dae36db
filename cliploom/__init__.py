"""Spark jobs for curating large media training sets."""
