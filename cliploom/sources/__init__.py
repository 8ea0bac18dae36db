"""Readers, writers and listings."""
