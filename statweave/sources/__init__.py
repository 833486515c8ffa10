"""Readers, writers and the version store."""
