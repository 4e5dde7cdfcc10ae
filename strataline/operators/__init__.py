"""Operators of the expression language, the panel builder, metrics and the factor collection."""
