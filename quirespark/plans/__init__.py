"""Registered queries, each with DuckDB SQL for the same rows where SQL can express it."""
