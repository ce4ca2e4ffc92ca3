"""Functions of the inspection dataflow."""
