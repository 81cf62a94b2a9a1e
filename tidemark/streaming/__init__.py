"""Structured Streaming jobs. Each transformation works on batch frames as well."""
