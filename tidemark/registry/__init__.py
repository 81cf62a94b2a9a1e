"""Registered queries: each with its Spark form and, where it exists, its SQL form."""
