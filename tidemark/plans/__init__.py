"""Whole tables of the product: features, serving tables, training and audit."""
