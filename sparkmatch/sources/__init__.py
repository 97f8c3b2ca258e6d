"""Readers, writers and transformations of graphs."""
