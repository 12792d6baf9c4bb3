"""Relational operators over catalogue tables: each takes and gives ``DataFrame``s."""
