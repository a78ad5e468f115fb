"""Composed pipelines, the query registry and its SQL twins."""
