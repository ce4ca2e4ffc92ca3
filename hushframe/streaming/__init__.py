"""Streaming of the inspection dataflow."""
