"""Operators of the inspection dataflow."""
