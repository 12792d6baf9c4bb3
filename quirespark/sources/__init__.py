"""Readers, writers and remote sources."""
